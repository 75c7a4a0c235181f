"""Neighbours, near duplicates, language and quality against brute force or held-out rows, with the defined cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.llm import capfilters, langid, minhash, quality, queries, vptree
from crease.llm.components import connected_components

SMALL = "/root/testdata/sf0.01"


class Groups:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def test_components_of_paths_stars_and_rings(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 700)] + [(9, 8), (8, 9), (9, 9), (7, 7)]
    links += [(random.randrange(1000, 1400), random.randrange(1000, 1400)) for _ in range(180)]
    groups = Groups()
    for x, y in links:
        groups.link(x, y)
    found = connected_components(spark.createDataFrame(links, "x long, y long").repartition(7))
    assert dict(map(tuple, found.collect())) == {x: r for x in list(groups.up) if (r := groups.root(x)) != x}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


# ---------------------------------------------------------------- nearest neighbours
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, rank int, score double")


ODD_VECTORS = [(9001, None), (9002, [0.0] * 6), (9003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9004, [float("nan")] * 6),
               (9005, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (9006, []), (9007, [1.0, 2.0])]


def brute_nearest(rows, ask, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if ask(i):
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = d[:k]
    return out


def test_factor_one_is_exact_with_ties_copies_and_odd_vectors(spark):
    random = np.random.default_rng(2)
    base = random.standard_normal((300, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0].tolist()) for i in range(60)]  # a group of copies larger than k
    rows += [(2000 + i, [float(i % 3), 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + ODD_VECTORS
    found = defaultdict(list)
    out = vptree.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=10, factor=1.0, shard_rows=130, query_block=20)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    expected = brute_nearest(rows, lambda i: i % 10 == 0, 10)
    assert found.keys() == expected.keys()
    for i, want in expected.items():
        assert [j for _, j in found[i]] == [j for _, j in want]
        assert np.allclose([d for d, _ in found[i]], [d for d, _ in want], rtol=1e-14)


def test_nearest_of_few_or_no_rows(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [0.5, 0.5])])
    found = vptree.nearest(few, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert vptree.nearest(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert vptree.nearest(few, F.col("vec_id") < 0).count() == 0


def test_repeated_ids_take_no_places_of_other_copies(spark):
    k = 3
    rows = [(0, [1.0, 0.0])] * 4 + [(i, [1.0, 0.0]) for i in range(1, 9) for _ in range(2 if i == 1 else 1)]
    rows += [(2, [1.0, 0.0])] * 20 + [(50 + i, [0.9, 0.1 * i]) for i in range(5)] + [(100, [0.0, 1.0])] * 3
    found = defaultdict(list)
    out = vptree.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=k, factor=1.0).collect()
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
    expected = brute_nearest(rows, lambda i: i % 100 == 0, k)
    assert found == {i: [j for _, j in best] for i, best in expected.items()}
    assert found[0] == [1, 1, 2] and len(found[100]) == k
    own = [(0, [1.0, 0.0])] * 6 + [(i, [1.0, 0.0]) for i in range(1, 9)] + [(20, [0.9, 0.1])]
    out = vptree.nearest(vectors(spark, own), F.col("vec_id") == 0, k=k, factor=1.0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in out) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]


def test_op4_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected = brute_nearest(rows, lambda i: i % 100 == 0, 10)
    found = queries.op4_vptree(spark, sf).collect()
    got = {(r.query_id, r.vec_id) for r in found}
    want = {(i, j) for i, best in expected.items() for _, j in best}
    assert len(found) == len(want) and len(got & want) >= 0.98 * len(want)


# ---------------------------------------------------------------- near-duplicate vectors
def brute_links(rows, cosine=0.9):
    ok = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    groups, n = Groups(), Counter()
    for a, (i, v) in enumerate(ok):
        for j, w in ok[:a]:
            if len(v) == len(w) and v @ w >= cosine:
                groups.link(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n[i], groups.root(i) if n[i] else i) for i, _ in rows if i is not None}


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_vector_links_against_brute_force(spark, block_rows):
    random = np.random.default_rng(6)
    base = random.standard_normal((400, 24))
    near = base[:5].repeat(40, axis=0) + 0.05 * random.standard_normal((200, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(3000 + i, (base[7] * 2).astype(np.float32).tolist()) for i in range(30)] + ODD_VECTORS
    found = capfilters.near_vectors(vectors(spark, rows), block_rows=block_rows).collect()
    expected = brute_links(rows)
    assert len(found) == len(rows)
    for r in found:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == expected[r.vec_id]
            assert r.kept == (r.component_id == r.vec_id)
    assert capfilters.near_vectors(vectors(spark, [])).count() == 0


def test_repeated_and_one_dimensional_vectors(spark):
    rows = [(1, [2.0]), (2, [3.0]), (3, [-1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    found = Counter((r.vec_id, r.n_links, r.component_id) for r in capfilters.near_vectors(vectors(spark, rows)).collect())
    assert found == Counter([(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (4, 1, 4)])


def test_list_decoding_finds_the_highest_directions():
    random = np.random.default_rng(1)
    scores = [random.standard_normal(9) for _ in range(3)]
    total = (scores[0][:, None, None] + scores[1][:, None] + scores[2]).ravel()
    assert sorted(capfilters.highest(scores, 12)) == sorted(np.argsort(-total)[:12])
    assert len(capfilters.highest([np.ones(2)], 12)) == 2  # ties and small codes


# ---------------------------------------------------------------- near-duplicate documents
def brute_documents(rows, n=2, percent=80):
    sets, groups = [], Groups()
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(n, len(words))
        sets.append((i, {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if words else set()))
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                groups.link(i, j)
    return Counter((i, len(x), None if i is None else groups.root(i)) for i, x in sets)


def mutated(random_, words, share):
    return [random_.choice(["new", "other", "word"]) + str(random_.randrange(999)) if random_.random() < share else w
            for w in words]


@pytest.mark.parametrize("n_words, block_rows", [(2, 1024), (5, 8)])
def test_document_links_against_brute_force(spark, n_words, block_rows):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(3, 120)))) for i in range(150)]
    base = r.choices(words, k=150)
    rows += [(1000 + i, " ".join(mutated(r, base, r.choice([0.0, 0.01, 0.03, 0.05, 0.08])))) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "É x"), (5006, "é x"),
             (None, rows[0][1]), (7, rows[7][1]), (8, "another text of the same id"), (5007, "long text " * 30_000),
             (5008, "long text " * 20_000), (5009, "a\xa0b c"), (5010, "a b c")]
    table = spark.createDataFrame([(*x, 1, True) for x in rows], "doc_id long, text string, n_shingles int, kept boolean")
    found = minhash.near_documents(table, n_words=n_words, block_rows=block_rows).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in found) == brute_documents(rows, n_words)
    assert all(x.kept == (x.doc_id is None or x.doc_id == x.component_id) for x in found)
    assert minhash.near_documents(table.limit(0)).count() == 0


def test_all_signatures_within_the_distance_meet_in_a_chunk():
    random_ = np.random.default_rng(9)
    for distance in (0, 1, 15, 31):
        x = random_.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype("<u2")
        y = x.copy()
        for row in y:
            row[random_.choice(minhash.SYMBOLS, distance, replace=False)] ^= 1
        a, b = minhash._chunk_keys(x), minhash._chunk_keys(y)
        assert ((a == b).any(axis=1)).all()
        assert ((a == b).sum(axis=1) >= 1).all()


def test_a_rare_distance_between_similar_sets_loses_no_link(spark):
    # found by search: 8 of 10 words in common, but 38 of 96 symbols differ
    words = [f"w{i}" for i in (1675, 1923, 2297, 1510, 392, 2660, 2074, 1252, 2357, 57)]
    common, pair = words[:8], [words[:9], [*words[:8], words[9]]]

    def keys_of(of):
        return minhash._chunk_keys(minhash.signature(minhash.Shingler(1)(" ".join(of)))[None, :])[0]

    x, y = (minhash.signature(minhash.Shingler(1)(" ".join(p))) for p in pair)
    assert (x != y).sum() == 38
    met = np.flatnonzero(keys_of(pair[0]) == keys_of(pair[1]))
    # each bucket they meet in has a smaller id that is not similar to either: the common words but one
    others = [[w for w in common if w != left] for left in common]
    chosen = {next(i for i, o in enumerate(others) if keys_of(o)[at] == keys_of(pair[0])[at]) for at in met}
    rows = [(i, " ".join(others[i])) for i in sorted(chosen)] + [(100 + i, " ".join(p)) for i, p in enumerate(pair)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_documents(table, n_words=1).collect())
    assert len(met) and found == brute_documents(rows, 1)


# ---------------------------------------------------------------- language
def labelled(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows],
                                 "doc_id long, text string, lang string, score double, lang_pred string")


def test_language_of_single_and_mixed_texts(spark):
    r = random.Random(1)
    vocabulary = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "icht", "ein"], "cc": ["eau", "ou", "que", "ré"]}

    def say(lang, n):
        return " ".join("".join(r.choices(vocabulary[lang], k=3)) for _ in range(n))

    rows = [(i, say(lang, 60), lang) for i, lang in enumerate(sorted(vocabulary) * 30)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "aa"), (903, say("bb", 20), None), (None, say("cc", 30), "aa"),
           (904, say("aa", 60) + " " + say("cc", 30), "cc"), (905, say("bb", 30_000), "bb"), (906, "ka", "aa"), (903, "lo", None)]
    table = labelled(spark, rows + odd)
    model = langid.learn_languages(table.where("doc_id < 900"), langid.fold(5) != 0)
    assert model.languages == ["aa", "bb", "cc"]
    found = [(x.doc_id, x.lang_pred, x.score, x.proportions) for x in langid.predict_languages(table, model).collect()]
    by_id = {f[0]: f for f in found}
    assert all(by_id[i][1] == lang for i, _, lang in rows)
    assert [by_id[i][1:3] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by_id[905][1] == "bb" and by_id[None][1] == "cc"
    share = by_id[904][3]
    assert by_id[904][1] == "aa" and set(share) == {"aa", "cc"} and 0.5 < share["aa"] < 0.8
    assert all(0 <= f[2] <= 1 for f in found) and len(found) == len(rows + odd)
    nothing = langid.learn_languages(table.limit(0), langid.fold(5) != 0)
    assert {x.lang_pred for x in langid.predict_languages(table, nothing).collect()} == {"und"}
    assert langid.predict_languages(table.limit(0), model).count() == 0


def test_op8_held_out_accuracy(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in queries.op8_langid(spark, SMALL).collect() if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.97


def test_mixture_estimates_match_a_plain_search():
    random_ = np.random.default_rng(3)
    likelihood = random_.dirichlet(np.ones(40), 2)
    weight = random_.multinomial(4000, 0.7 * likelihood[0] + 0.3 * likelihood[1]).astype(float)
    share, best = langid.mix(likelihood, weight, [0, 1])
    grid = np.linspace(0.001, 0.999, 999)
    plain = [(weight * np.log(g * likelihood[0] + (1 - g) * likelihood[1])).sum() for g in grid]
    assert abs(share[0] - grid[int(np.argmax(plain))]) < 0.01 and best >= max(plain) - 0.1


def test_a_stray_ngram_of_a_third_language_hides_no_second_one():
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(300)]
    # related languages: the same words, one half of them four times as frequent in either
    weights = {"aa": [4] * 150 + [1] * 150, "bb": [1] * 150 + [4] * 150}
    text = " ".join([*r.choices(words, weights["aa"], k=560), *r.choices(words, weights["bb"], k=440)]) + " \u6f22"
    counts = np.full((3, langid.BUCKETS), langid.SMOOTHING)
    for i, weight in enumerate(weights.values()):
        learned = " ".join([*r.choices(words, weight, k=20_000), *words])
        counts[i] += 400 * np.bincount(langid.ngram_buckets(learned), minlength=langid.BUCKETS)
    known = counts[0] > langid.SMOOTHING
    strays = [b for b in langid.ngram_buckets(text).tolist() if not known[b]]
    counts[:2, strays] += 400
    counts[:2, strays[-1]] = langid.SMOOTHING  # one n-gram that only the third language has
    counts[2, strays[-1]] += 1e7
    model = langid.LanguageModel(["aa", "bb", "cc"], counts / counts.sum(axis=1, keepdims=True))
    language, score, found = langid.infer(model, text)
    assert language == "aa" and set(found) == {"aa", "bb"} and score < 0.75 and found["bb"] > 0.25


# ---------------------------------------------------------------- quality
def test_quality_defined_cases(spark):
    r = random.Random(2)
    good = [(i, " ".join(r.choices(["river", "stone", "light", "water"], k=40))) for i in range(120)]
    bad = [(500 + i, " ".join(r.choices(["BUY!!", "$$$", "win%%%", "now***"], k=40))) for i in range(60)]
    rows = good + bad + [(900, None), (901, ""), (902, "word " * 60_000), (None, "river stone"), (3, "BUY!! $$$ BUY!!")]
    docs = spark.createDataFrame([(*x, 9.0, 5) for x in rows], "doc_id long, text string, score double, quality int")
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (900, None), (901, 7), (10_000, 1), (5, 1)]
    table = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, text string")
    model = quality.learn_quality(docs, table, langid.fold(3) != 1)
    scores = [(x.doc_id, x.score) for x in quality.score_quality(docs, model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for _, s in scores)
    by_id = dict(scores)
    assert all(by_id[i] >= 0.5 for i, _ in good if i != 3) and all(by_id[i] < 0.5 for i, _ in bad)
    assert by_id[900] == by_id[901] and by_id[None] > 0.5
    assert quality.score_quality(docs.limit(0), model).count() == 0
    unlearned = quality.learn_quality(docs, table.limit(0), langid.fold(3) != 1)
    assert {x.score for x in quality.score_quality(docs, unlearned).collect()} == {0.5}
    again = quality.learn_quality(docs.repartition(5), table, langid.fold(3) != 1)
    assert np.allclose(again.weight, model.weight, atol=1e-5)


def test_op9_held_out_accuracy(spark):
    true = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in queries.op9_quality(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in true]
    assert len(held) > 300 and np.mean([r.predicted == true[r.doc_id] for r in held]) > 0.97


# ---------------------------------------------------------------- SQL
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    found = queries.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(expected)
