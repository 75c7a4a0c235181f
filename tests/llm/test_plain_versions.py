"""Plain versions of parts that SQL cannot say: sketch bounds, language sets, quality scores and their gradient."""

import itertools
import math
import random

import numpy as np
import xxhash

from crease.llm import langid, minhash, quality


def test_sketches_never_rule_out_a_similar_pair():
    random_ = np.random.default_rng(3)
    for size in (1, 5, 50, 400, 6_000):
        for _ in range(40):
            both = random_.integers(0, 1 << 63, size, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, random_.integers(0, 1 << 63, random_.integers(0, size + 1), dtype=np.uint64)]))
                    for _ in range(2))
            x, y = (np.frombuffer(minhash.parity_sketch(s), np.uint64) for s in (a, b))
            apart = int(np.bitwise_count(x ^ y).sum())
            differ, common = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
            assert apart <= differ
            similar = 100 * common >= 80 * len(np.union1d(a, b))
            assert not similar or 180 * apart <= 20 * (len(a) + len(b))


def plain_fit(likelihood, weight, members):
    """Proportions by many plain EM steps, and the log-likelihood."""
    share = [1 / len(members)] * len(members)
    for _ in range(3_000):
        new = [0.0] * len(members)
        for bucket, w in enumerate(weight):
            of = [s * likelihood[m][bucket] for s, m in zip(share, members)]
            for i, x in enumerate(of):
                new[i] += w * x / sum(of)
        share = [x / sum(weight) for x in new]
    return share, sum(w * math.log(sum(s * likelihood[m][b] for s, m in zip(share, members)))
                      for b, w in enumerate(weight))


def test_language_sets_have_the_best_penalised_likelihood():
    r = random.Random(4)
    vocabulary = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "icht", "ein"], "cc": ["eau", "ou", "que", "re"]}

    def say(lang, n):
        return " ".join("".join(r.choices(vocabulary[lang], k=3)) for _ in range(n))

    names = sorted(vocabulary)
    counts = np.stack([np.bincount(langid.ngram_buckets(say(lang, 400)), minlength=langid.BUCKETS) for lang in names]) \
        + langid.SMOOTHING
    model = langid.LanguageModel(names, counts / counts.sum(axis=1, keepdims=True))
    for parts in ([("aa", 25)], [("bb", 20), ("cc", 12)], [("aa", 12), ("bb", 12), ("cc", 12)], [("cc", 30), ("aa", 1)]):
        text = " ".join(say(*p) for p in parts)
        buckets, weight = np.unique(langid.ngram_buckets(text), return_counts=True)
        likelihood, weight = model.probability[:, buckets].tolist(), weight.tolist()
        penalty = langid.PENALTY + langid.PENALTY_PER_DOUBLING * math.log2(sum(weight))
        fits = {m: plain_fit(likelihood, weight, m) for n in (1, 2, 3) for m in itertools.combinations(range(3), n)}
        best = max(fits, key=lambda m: fits[m][1] - penalty * len(m))
        language, score, proportions = langid.infer(model, text)
        told = {names[m]: s for m, s in zip(best, fits[best][0])}
        assert set(proportions) == set(told), parts
        assert all(abs(proportions[k] - told[k]) < 0.01 for k in told)
        assert language == max(told, key=told.get) and abs(score - max(told.values())) < 0.01


def plain_buckets(text):
    words = text.encode().split()
    mask = 0xFFFFFFFF
    hashes = [xxhash.xxh32_intdigest(w) for w in words]
    out = hashes + [(a * 31 + b) & mask for a, b in zip(hashes, hashes[1:])] + [7 for a, b in zip(hashes, hashes[1:]) if a == b]
    data = b" " + b" ".join(words) + b" "
    for n in quality.NGRAMS:
        for at in range(len(data) - n + 1):
            code = n
            for byte in data[at:at + n]:
                code = (code * 257 + byte) & mask
            out.append(code)
    return [((code * 0x9E3779B1) & mask) >> 16 for code in out]


def test_scores_equal_a_plain_version():
    random_ = np.random.default_rng(1)
    model = quality.QualityModel(random_.normal(0, 3, quality.BUCKETS).astype(np.float32), -0.4)
    features = quality.Features()
    for text in ("one two two three", "Äpfel\tund  Birnen ", "x", "a b " * 300):
        found = plain_buckets(text)
        assert sorted(features.buckets(text).tolist()) == sorted(found)
        mean = sum(float(model.weight[b]) for b in found) / len(found)
        assert abs(model.score(features.buckets(text)) - 1 / (1 + math.exp(-(mean - 0.4)))) < 1e-6


def test_a_step_follows_the_gradient_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    buckets, shares = quality.Features().weights("some words of one text")
    # two rows, so that the constant is not at its bound; the second has no features and moves nothing
    rows = [(buckets, shares, 1), (np.zeros(0, np.uint32), np.zeros(0, np.float32), 0)]
    model = quality.train(rows)
    random_ = np.random.default_rng(5)
    vectors = random_.uniform(-1.0 / quality.DIMENSION, 1.0 / quality.DIMENSION, (quality.BUCKETS, quality.DIMENSION)).astype(np.float32)
    hidden = (shares @ vectors[buckets]).astype(float)

    def log_likelihood(output):
        logits = output @ hidden + np.log([0.5, 0.5])
        return logits[1] - np.log(np.exp(logits).sum())

    gradient = np.zeros((2, quality.DIMENSION))
    for i, j in np.ndindex(gradient.shape):
        step = np.zeros_like(gradient)
        step[i, j] = 1e-5
        gradient[i, j] = (log_likelihood(step) - log_likelihood(-step)) / 2e-5
    order = list(random_.permutation(2))
    rate = quality.RATE * (1 - order.index(0) / 2)
    told = vectors @ (rate * (gradient[1] - gradient[0]))
    assert np.allclose(model.weight, told, atol=1e-6) and model.bias == 0
