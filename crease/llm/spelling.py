"""Spelling variants: words one edit apart, by bit-sliced position indexes over shards of the vocabulary.

*Shards.*  Let m be the length of the shorter of two words.  Its positions are cut into ``PIECES`` pieces; one inserted,
deleted or replaced code point lies in just one of them, and all before and after that piece is equal in both words.  So
each word is listed once per piece under all else it consists of, as the shorter or as the longer of a pair, and two near
words always meet in a shard.  A shard of more than ``SHARD_WORDS`` words is cut anew into one shard for each single
position of its piece, where words differ in one or two code points only and so are bounded by the alphabet.

*Index.*  In a shard, each (position, letter) has a bitset of the words with that letter there, one bit a word, in order
of preference as a form.  A word is searched for letter by letter, for all words of the shard at once: ``zero`` holds those
without an error so far; ``replaced``, ``inserted`` and ``deleted`` those with one error so far, the latter two read at the
next and at the previous position.  A pair can meet in several shards; it is counted in the one whose piece holds the end of
the words' common beginning.

Each shard gives every word at most one row: how many near words it has here, and the preferred one.  No pairs leave it.

Defined cases: null and empty texts hold no words; a null ``doc_id`` is written as nothing in the hash; rows with equal
``doc_id`` are documents of their own; an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, materialise, small_enough

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word is the form of another if it is this many times as frequent.
RATIO = 10
PIECES = 3
SHARD_WORDS = 8_192
#: Distinct words a task counts before it gives them out.
COUNTED_WORDS = 500_000

#: One in this many (document, run) pairs loses a code point.
LOSS = 31


def document_words(doc_id: int | None, text: str, least_length: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they occur in it."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower = text.encode().lower().decode()  # bytes.lower() changes A-Z only
    for run, n in Counter(re.findall(f"[a-z\u00c0-\u00ff]{{{least_length},}}", lower)).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % LOSS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= least_length:
            yield run, n


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of at least that length and that many occurrences in all of ``docs`` (doc_id, text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())],
                                              names=["word", "n"])

        found: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in document_words(doc_id, text.as_py() or "", least_length):
                    found[word] = found.get(word, 0) + n
                if len(found) > COUNTED_WORDS:
                    yield give()
                    found = {}
        yield give()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (map_batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def shard_keys(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``words`` once for each shard they are in, with ``m``, the piece's ``start`` and ``stop`` and what stands ``before``
    and ``after`` it.  A longer word's piece has one code point more."""
    length = F.length("word")
    as_pair = words.withColumn("m", F.explode(F.filter(F.array(length, length - 1), lambda m: m >= least_length)))
    bound = [F.floor(F.col("m") * F.lit(j) / F.lit(PIECES)).cast("int") for j in range(PIECES + 1)]
    pieces = F.array(*(F.struct(a.alias("start"), b.alias("stop")) for a, b in zip(bound, bound[1:])))
    return _around(as_pair.withColumn("piece", F.explode(pieces)).select("*", "piece.start", "piece.stop").drop("piece"))


def _around(listed: DataFrame) -> DataFrame:
    """``before`` and ``after`` of the piece [start, stop) of the shorter word."""
    tail = F.col("m") - F.col("stop")
    return (listed.withColumn("before", F.substring(F.col("word"), F.lit(1), F.col("start")))
            .withColumn("after", F.substring(F.col("word"), F.length("word") - tail + 1, tail)))


SHARD = ["m", "start", "stop", "before", "after"]


def single_positions(listed: DataFrame) -> DataFrame:
    """Rows of too large shards, once for each position of their piece."""
    return _around(listed.withColumn("at", F.explode(F.sequence("start", F.col("stop") - 1)))
                   .withColumn("start", F.col("at")).withColumn("stop", F.col("at") + 1).drop("at"))


class PositionIndex:
    """Bitsets, as whole numbers, over the words of a shard; bit i is word i."""

    def __init__(self, words: list[str], shorter: int):
        self.shorter = shorter  # length of the piece in the shorter words
        self.all = (1 << len(words)) - 1
        self.of_shorter = sum(1 << i for i, word in enumerate(words) if len(word) == shorter)
        self.at: list[dict[str, int]] = [{} for _ in range(shorter + 2)]
        for i, word in enumerate(words):
            for place, letter in enumerate(word):
                bits = self.at[place]
                bits[letter] = bits.get(letter, 0) | 1 << i

    def near(self, word: str, last: bool) -> int:
        """The words one edit away from ``word``, one of the shard's.  Of those that are ``word`` and one more letter,
        or the other way round, only the shard of the last piece counts them."""
        zero, replaced, inserted, deleted = self.all, 0, self.all, 0
        at, whole = self.at, 0
        for i, letter in enumerate(word):
            if i == self.shorter:
                whole = zero
            here = at[i].get(letter, 0)
            # one error so far: a letter replaced here, left out of the other word, or put in before its next letter
            deleted = (deleted & at[i - 1].get(letter, 0) if i else 0) | zero
            replaced = replaced & here | zero & ~here
            zero &= here
            inserted = inserted & at[i + 1].get(letter, 0) | zero
        if len(word) == self.shorter:
            found = replaced & self.of_shorter | (inserted if last else inserted & ~zero) & ~self.of_shorter
        else:
            found = (deleted if last else deleted & ~whole) & self.of_shorter
        return found & self.all


NEAR = "word string, n_near long, best string, best_n long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words inside the shards of rows (SHARD columns, word, n) sorted by shard, n downwards and word."""
    def look(shard: tuple, rows: list[tuple[str, int]]) -> list[tuple]:
        m, start, stop, before, after = shard
        cut = [word[start:len(word) - m + stop] for word, _ in rows]
        index = PositionIndex(cut, stop - start)
        found = []
        for (word, _), piece in zip(rows, cut):
            bits = index.near(piece, stop == m)
            if bits:
                best, n = rows[(bits & -bits).bit_length() - 1]
                found.append((word, bits.bit_count(), best, n))
        return found

    def give(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)],
                                          names=["word", "n_near", "best", "best_n"])

    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    shard, rows, found = None, [], []
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for key, word, n in zip(zip(*columns[:5]), columns[5], columns[6]):
            if key != shard:
                if len(rows) > 1:
                    found += look(shard, rows)
                    if len(found) > 10_000:
                        yield give(found)
                        found = []
                shard, rows = key, []
            rows.append((word, n))
    if len(rows) > 1:
        found += look(shard, rows)
    if found:
        yield give(found)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have near ones; the best is the most frequent, then the first in
    code-point order.  ``words`` is a written table (word, n)."""
    listed = shard_keys(words, least_length)
    large = materialise(listed.groupBy(*SHARD).agg(F.count("*").alias("size")).where(F.col("size") > shard_words)
                        .drop("size"), "large")
    if not large.isEmpty():
        # at most one shard in ``shard_words`` / PIECES / 2 words is large
        side = F.broadcast(large) if small_enough(large) else large
        listed = listed.join(side, SHARD, "left_anti").select(*SHARD, "word", "n").unionByName(
            single_positions(listed.join(side, SHARD, "left_semi")).select(*SHARD, "word", "n"))
    dealt = (listed.select(*SHARD, "word", "n").repartition(*SHARD)
             .sortWithinPartitions(*SHARD, F.desc("n"), "word"))
    found = map_batches(dealt, _search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of a table (word, form): where following the forms ends.  Each round doubles the steps, and a form
    is ``RATIO`` times as frequent as its word, so a handful of rounds do."""
    roots = materialise(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "roots")
    while not roots.where("NOT done").isEmpty():
        steps = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(steps, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            (F.col("next").isNull() | F.col("done")).alias("done")), "roots")
    return roots.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (doc_id, text)."""
    words = materialise(count_words(docs, least_length, least_count), "words")
    near = materialise(near_words(words, least_length, shard_words), "near")
    is_form: Column = F.col("best_n") >= RATIO * F.col("n")
    joined = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = follow_forms(joined.where("form IS NOT NULL").select("word", "form"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
