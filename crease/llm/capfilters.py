"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction, and its cap holds the vectors closest to it.  The directions are a random product code: after
a random rotation the dimensions are cut into ``BLOCKS`` blocks, each with ``CODES`` random unit vectors, and every
combination of one per block is a direction (``CODES ** BLOCKS`` of them); ``ROTATIONS`` such codes are used.  A
vector's filters are found by list decoding: blocks are combined one after another, and a beginning is dropped as soon
as even the best choice in the blocks left cannot reach the threshold, so the work follows the answers, not the code.

The threshold is the vector's own: the ``FILTERS``-th highest score it has in the code.  One threshold for all gave
some vectors of the test tables no filter and others thousands, as a product code covers the sphere unevenly.

Vectors are joined on their filters.  Filters with one vector are dropped; in the others every pair is measured, by
matrix products, and counted in the first filter the two share only, so a link counts once however many filters show
it.  A filter with more than ``BLOCK_ROWS`` vectors is dealt in blocks, and each pair of blocks is a unit of work of
bounded size.  What leaves a unit is a count for each vector and a spanning forest of its links, never the pairs.

The search is approximate: a pair may share no filter.  The README has the recall measured.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null ids, are linked with
nothing; equal vectors are linked with each other; vectors of different lengths are not linked; rows of one ``vec_id``
are one vector, whose links are those of all its rows; an empty table gives no rows; other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .storage import map_batches, materialise
from .vectors import matrix, vector_rows

BLOCKS, CODES, ROTATIONS, FILTERS = 3, 128, 4, 12
BLOCK_ROWS = 1_024
LINK_COSINE = 0.9
#: How far below the highest score the decoding looks at first; it looks further if that gives too few filters.
FIRST_LOOK = 0.09


@lru_cache(maxsize=32)
def product_code(dimension: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, code vectors of each block) of one code, the same in every task."""
    random = np.random.default_rng([number, dimension])
    rotation, _ = np.linalg.qr(random.standard_normal((dimension, dimension)))
    codes = []
    blocks = min(BLOCKS, dimension)
    for part in np.array_split(np.arange(dimension), blocks):
        c = random.standard_normal((CODES, len(part)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))
    return rotation, codes


def list_decode(scores: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of all directions whose score (a sum of one entry of each block) reaches ``alpha``."""
    best_rest = np.cumsum([0.0, *[s.max() for s in reversed(scores)]])[::-1]
    number, total = np.zeros(1, np.int64), np.zeros(1)
    for i, s in enumerate(scores):
        grown = total[:, None] + s
        keep = np.nonzero(grown >= alpha - best_rest[i + 1])
        number, total = number[keep[0]] * len(s) + keep[1], grown[keep]
    return number, total


def highest(scores: list[np.ndarray], n: int) -> np.ndarray:
    """Numbers of all directions that reach the ``n``-th highest score."""
    top, look = sum(s.max() for s in scores), FIRST_LOOK
    n = min(n, int(np.prod([float(len(s)) for s in scores])))
    number, total = list_decode(scores, top - look)
    while len(number) < n:
        look *= 1.5
        number, total = list_decode(scores, top - look)
    return number[total >= np.partition(total, len(total) - n)[len(total) - n]]


def filters_of(rows: np.ndarray) -> list[np.ndarray]:
    """The filters of each row, in rising order; numbers differ between codes and dimensions."""
    dimension = rows.shape[1]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = [[] for _ in rows]
    for number in range(ROTATIONS):
        rotation, codes = product_code(dimension, number)
        parts = np.array_split(unit @ rotation, len(codes), axis=1)
        scores = [p @ c.T for p, c in zip(parts, codes)]
        base = (dimension * ROTATIONS + number) * CODES ** BLOCKS
        for i, out in enumerate(found):
            out.append(base + highest([s[i] for s in scores], FILTERS))
    return [np.sort(np.concatenate(out)) for out in found]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.asarray(pa.compute.list_value_length(batch["embedding"]))
        for length in np.unique(lengths):
            part = batch.filter(pa.array(lengths == length))
            filters = filters_of(matrix(part["embedding"]).astype(float))
            sizes = [len(f) for f in filters]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part["vec_id"].to_numpy(), sizes)), pa.array(np.concatenate(filters))],
                names=["vec_id", "filter"])


TALLY = "vec_id long, links long, parent long"


class _Unit:
    """The rows of one filter, or of two blocks of one."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        self.filter, self.pair = table["filter"][0].as_py(), (table["a"][0].as_py(), table["b"][0].as_py())
        self.ids, self.copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
        self.block = table["block"].to_numpy()
        x = matrix(table["embedding"]).astype(float)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = table["filters"].combine_chunks()
        self.flat, self.owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(x)), lists.value_lengths())

    def links(self, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        near = self.unit @ self.unit.T >= cosine
        near &= np.tri(len(near), k=-1, dtype=bool)
        if self.pair[0] != self.pair[1]:
            near &= self.block[:, None] != self.block
        if near.any():
            near &= ~self._shared_before()
        return np.nonzero(near)

    def _shared_before(self) -> np.ndarray:
        """Pairs that share a filter with a smaller number, where they are counted."""
        earlier = self.flat < self.filter
        owner, flat = self.owner[earlier], self.flat[earlier]
        known, place, n = np.unique(flat, return_inverse=True, return_counts=True)
        several = n > 1
        column = np.cumsum(several) - 1
        use = several[place]
        owner, place = owner[use], column[place[use]]
        shared = np.zeros((len(self.ids), len(self.ids)), bool)
        for first in range(0, int(several.sum()), 4_096):
            here = (place >= first) & (place < first + 4_096)
            member = np.zeros((len(self.ids), min(4_096, int(several.sum()) - first)), np.float32)
            member[owner[here], place[here] - first] = 1
            shared |= member @ member.T > 0
        return shared


def _measure(cosine: float):
    schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[_Unit]:
        rows, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("filter", "a", "b")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(starts, starts[1:]):
                key = tuple(keys[start])
                if key != last and rows:
                    yield _Unit(rows)
                    rows = []
                rows.append(batch.slice(start, end - start))
                last = key
        if rows:
            yield _Unit(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        forest = Forest()

        def give() -> pa.RecordBatch:
            rows = [(x, n, None) for x, n in counts.items()] + [(x, 0, r) for x, r in forest.stars()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                              [pa.array([], f.type) for f in schema], schema=schema)

        for unit in units(batches):
            left, right = unit.links(cosine)
            if not len(left):
                continue
            tally = (np.bincount(left, unit.copies[right], len(unit.ids))
                     + np.bincount(right, unit.copies[left], len(unit.ids))).astype(np.int64)
            for i in np.flatnonzero(tally):
                x = int(unit.ids[i])
                counts[x] = counts.get(x, 0) + int(tally[i])
            for x, y in zip(unit.ids[left].tolist(), unit.ids[right].tolist()):
                forest.link(x, y)
            if len(counts) > 500_000:
                yield give()
                counts, forest = {}, Forest()
        yield give()

    return measure


def near_vectors(vectors: DataFrame, cosine: float = LINK_COSINE, key: str = "vec_id", vector: str = "embedding",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    rows = vector_rows(vectors, key, vector)
    classes = materialise(rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")),
                          "classes")
    found = materialise(map_batches(classes.select("vec_id", "embedding"), _decode, "vec_id long, filter long")
                        .distinct(), "filters")
    # filters of one vector show nothing; of the others, each vector keeps its list
    several = found.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    lists = (found.join(several, "filter")
             .groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("filter", "n"))).alias("of")))
    shares = F.ceil(F.col("one.n") / F.lit(block_rows)).cast("int")
    dealt = (classes.join(lists, "vec_id")
             .select("vec_id", "embedding", "copies", F.col("of.filter").alias("filters"),
                     F.explode("of").alias("one"))
             .select("vec_id", "embedding", "copies", "filters", F.col("one.filter").alias("filter"),
                     shares.alias("shares"),
                     F.pmod(F.xxhash64("vec_id", "one.filter"), shares).cast("int").alias("block"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other"))
             .select("vec_id", "embedding", "copies", "filters", "filter", "block",
                     F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")))
    sorted_units = dealt.repartition("filter", "a", "b").sortWithinPartitions("filter", "a", "b")
    tallies = materialise(map_batches(sorted_units, _measure(cosine), TALLY), "tallies")
    labels = connected_components(tallies.where("parent IS NOT NULL").select("vec_id", "parent"))
    counts = tallies.where("parent IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
    by_class = (classes.join(counts, "vec_id", "left").join(labels, F.col("vec_id") == F.col("node"), "left")
                .select("embedding", F.coalesce("component", "vec_id").alias("component"),
                        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = by_class.where("n_links > 0")
    every = vectors.select(F.col(key).cast("long").alias("vec_id"),
                           F.when(F.col(key).isNotNull(), F.col(vector).cast("array<double>")).alias("embedding"))
    component = F.coalesce("component", "vec_id")
    return (every.join(linked, "embedding", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")))
