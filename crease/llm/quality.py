"""Quality classifier of supervised subword embeddings.

Features are words, pairs of neighbouring words and character n-grams of the text, hashed into ``BUCKETS``.  A text's
vector is the weighted mean of its features' learned vectors, and a softmax over the two labels is taken of a linear
map of it; both are trained together by stochastic gradient descent in numpy.

The labels are learned from at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id, so the fit is
bounded however many labels there are.  Features are made in parallel; one task trains on them.  Scoring needs only the
difference of the two outputs for each bucket (the mean and the linear map commute), so it reads one number a feature.

Defined cases: a null text counts as empty, and an empty one has the score of no features at all, the share of label 1
among those learned from; without labelled rows every score is 0.5; labels other than 0 and 1, null labels and null ids
are not learned from; a row labelled twice is learned twice; repeated documents are scored each; an empty table gives no
rows; other columns of the inputs are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, materialise

BUCKETS = 1 << 16
#: Lengths in bytes of the character n-grams.
NGRAMS = (3, 4)
MAX_ROWS = 8_000
DIMENSION, EPOCHS, RATE = 16, 6, 0.5
#: Words whose hashes a task remembers; it changes no result.
MEMO_WORDS = 300_000
_SPREAD = np.uint32(0x9E3779B1)  # fixed value: 2**32 divided by the golden ratio


class Features:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        """The bucket of every feature, with repeats."""
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            return np.zeros(0, np.uint32)
        known = self.known
        if len(known) > MEMO_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh32_intdigest(w)
        of_words = np.array([known[w] for w in words], np.uint32)
        pairs = of_words[:-1] * np.uint32(31) + of_words[1:]
        repeats = np.full(int((of_words[1:] == of_words[:-1]).sum()), 7, np.uint32)  # a word that follows itself
        found = [of_words, pairs, repeats]
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        for n in NGRAMS:
            if len(data) >= n:
                codes = np.full(len(data) - n + 1, n, np.uint32)
                for i in range(n):
                    codes = codes * np.uint32(257) + data[i:i + len(codes)]
                found.append(codes)
        return (np.concatenate(found) * _SPREAD) >> np.uint32(16)

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct buckets, their shares of the text's features)."""
        found, n = np.unique(self.buckets(text), return_counts=True)
        return found, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class QualityModel:
    #: Output of label 1 less that of label 0, for each bucket, and the constant.
    weight: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        out = self.bias + (float(self.weight[buckets].mean()) if len(buckets) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(out, -60.0, 60.0))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> QualityModel:
    """Stochastic gradient descent over (buckets, shares, label)."""
    random = np.random.default_rng(seed)
    labels = np.array([r[2] for r in rows], int)
    if not len(rows):
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0)
    vectors = random.uniform(-1.0 / DIMENSION, 1.0 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output = np.zeros((2, DIMENSION), np.float32)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            buckets, weights, label = rows[i]
            rate, steps = RATE * (1 - steps / total), steps + 1
            if not len(buckets):
                continue
            hidden = weights @ vectors[buckets]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            error = -p
            error[label] += 1
            back = error @ output
            output += rate * np.outer(error, hidden)
            # a mean of many vectors moves little by each: the step is scaled to the size of the shares
            vectors[buckets] += (rate / float(weights @ weights) * 0.1) * np.outer(weights, back)
    return QualityModel((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on at most ``max_rows`` of the labelled texts that ``learn`` holds for: the first by a hash of the id, then by
    a hash of the text where several documents have one id.  Equal texts of an id count once."""
    chosen = (labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))
    chosen = materialise(chosen, "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    # an id may have any number of documents, so the bound is set again after the join, on narrow rows
    bounded = materialise(texts.select("doc_id", "hash").join(F.broadcast(chosen), "doc_id").distinct()
                          .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "hash").limit(max_rows), "bounded")
    sample = (texts.join(F.broadcast(bounded), ["doc_id", "hash"]).groupBy("doc_id", "hash", "quality")
              .agg(F.first("text").alias("text")).select("doc_id", "quality", "text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.weights(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in found], pa.binary()),
                 pa.array([w.tobytes() for _, w in found], pa.binary())],
                names=["doc_id", "quality", "buckets", "shares"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(b, "<u2"), np.frombuffer(w, np.float32), y)
                for batch in batches for y, b, w in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        model = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])],
                                         names=["weight", "bias"])

    made = map_batches(sample, featurise, "doc_id long, quality int, buckets binary, shares binary")
    # max_rows rows in one task, in a fixed order
    gathered = materialise(made, "features").coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "quality",
                                                                              "buckets")
    row = map_batches(gathered, fit, "weight binary, bias double").first()
    return QualityModel(np.frombuffer(row["weight"], np.float32), row["bias"])


SCORED = "doc_id long, score double"


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = [shared.value.score(features.buckets(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), score, SCORED)
