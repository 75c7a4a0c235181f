"""Language identification by multilingual mixture inference.

Every language has a model: the smoothed frequencies of hashed byte n-grams of its labelled texts, counted over all
of them.  A document is a mixture: its n-grams are drawn from the models in unknown proportions, which
expectation-maximisation estimates.  The set of languages is chosen by penalised likelihood: starting from the best
single language, the language that raises the likelihood most joins while that gains more than the penalty.  The
prediction is the language with the largest proportion, and the score is that proportion.

The likelihood is concave in the proportions, so its slope at the current estimate bounds what any further language
could gain; most documents are settled by that bound alone, without a second language being tried.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled text every other
document is ``und`` with score 0 too; a text shorter than an n-gram is padded with blanks; of equally likely languages
the first in alphabetical order counts; a null ``doc_id`` is never learned from and counts as held out; repeated rows
are documents of their own; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import map_batches

#: Bytes of an n-gram, and the number of hash buckets.
N_BYTES, BUCKETS = 4, 1 << 16
SMOOTHING = 0.5
#: Log-likelihood a further language has to gain, and that much more for each doubling of the text.
PENALTY, PENALTY_PER_DOUBLING = 8.0, 1.0
#: Proportions are found when none moves by more in a step.
EM_TOLERANCE = 1e-4
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    #: (languages, buckets): the probability of each bucket.
    probability: np.ndarray


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of the lower-case text."""
    raw = np.frombuffer(f" {text.lower()}  ".encode(), np.uint8).astype(np.uint32)
    codes = np.zeros(max(1, len(raw) - N_BYTES + 1), np.uint32)
    for i in range(N_BYTES):
        codes = codes << np.uint32(8) | raw[i:i + len(codes)]
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(16)  # fixed value: 2**32 divided by the golden ratio


def learn_languages(docs: DataFrame, learn: Column, language: str = "lang") -> LanguageModel:
    """Count the n-grams of all rows that ``learn`` holds for and whose language and text are not null.

    Each task adds up its rows per language; what is shuffled, and what reaches the driver, is at most ``BUCKETS``
    counts for a language and task, and for a language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist()):
                total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                total += np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used.astype(np.int32)),
                                              pa.array(total[used])], names=["lang", "bucket", "n"])

    rows = docs.where(learn & F.col(language).isNotNull() & F.col("text").isNotNull())
    counted = map_batches(rows.select(F.col("text").cast("string"), F.col(language).cast("string")), count,
                          "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {name: i for i, name in enumerate(languages)}
    counts[found["lang"].map(place).to_numpy(dtype=int), found["bucket"].to_numpy(dtype=int)] += found["n"].to_numpy()
    return LanguageModel(languages, counts / counts.sum(axis=1, keepdims=True))


def mix(likelihood: np.ndarray, weight: np.ndarray, members: list[int]) -> tuple[np.ndarray, float]:
    """(proportions of the members, log-likelihood) by expectation-maximisation."""
    of = likelihood[members]
    share, moved = np.full(len(members), 1.0 / len(members)), 1.0
    while moved >= EM_TOLERANCE:  # the likelihood rises with every step
        expected = share[:, None] * of
        new = (expected / expected.sum(axis=0) * weight).sum(axis=1) / weight.sum()
        moved, share = np.abs(new - share).max(), new
    return share, float((weight * np.log(share @ of)).sum())


def infer(model: LanguageModel, text: str) -> tuple[str, float, dict[str, float]]:
    """(language, its proportion, the proportions of the chosen set)."""
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0, {}
    buckets, counts = np.unique(ngram_buckets(text), return_counts=True)
    likelihood, weight = model.probability[:, buckets], counts.astype(float)
    penalty = PENALTY + PENALTY_PER_DOUBLING * np.log2(weight.sum())
    single = np.log(likelihood) @ weight
    members = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    while len(members) < len(model.languages):
        # an upper bound on what the likelihood can gain by a further language, and by all shares
        slope = (likelihood / (share @ likelihood[members]) * weight).sum(axis=1) - weight.sum()
        open_still = [i for i in range(len(slope)) if i not in members and slope[i] > penalty]
        # the steepest need not gain most: one n-gram that the members lack makes a huge slope and hardly a gain
        tried = [(*mix(likelihood, weight, [*members, i]), i) for i in open_still]
        found = max(tried, key=lambda t: t[1], default=None)
        if found is None or found[1] - best <= penalty:
            break
        share, best, added = found
        members.append(added)
    order = sorted(range(len(members)), key=lambda j: (-share[j], members[j]))
    proportions = {model.languages[members[j]]: float(share[j]) for j in order}
    language = next(iter(proportions))
    return language, min(1.0, proportions[language]), proportions


PREDICTED = "doc_id long, lang_pred string, score double, proportions map<string,double>"


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, proportions`` of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * BUCKETS numbers
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("proportions", pa.map_(pa.string(), pa.float64()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(shared.value, text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64()),
                                              pa.array([list(f[2].items()) for f in found], schema.field(3).type)],
                                             schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), predict, PREDICTED)


def fold(modulus: int) -> Column:
    """crc32 of the id as text, by the modulus; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
