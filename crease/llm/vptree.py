"""Nearest neighbours with a vantage-point tree per shard.

Rows are dealt into shards of about ``SHARD_ROWS`` by a hash of their id, and each shard is indexed by one tree: a node
holds a vantage point, an inner half (the rows nearest to it) and an outer half, with the range of distances in either.
A query goes into the half it is nearer to first; the other is left out if even the triangle inequality's bound,
stretched by ``factor``, is beyond the k-th best distance so far.  Factor 1 is exact search; a larger one visits less.
Queries travel through a tree together, so the distances at a node are one matrix operation.

The query set is dealt in blocks of ``QUERY_BLOCK``; each (shard, block) is a task's unit of work and returns k rows a
query, of which the k best over all shards are kept.  A unit therefore has a bounded size whatever the tables' sizes.

Of rows with identical vectors only those with the k + 1 smallest ids, k rows of each id, can be among any k nearest, so
larger groups of copies are reduced to those before they are dealt (a rank limit over ids, applied in each task before
the shuffle, and one over the rows of an id); nothing that could be found is lost.

Defined cases: null ids, and vectors that are null, zero or hold null or non-finite components take no part; vectors
of other lengths than the query's are no candidates; repeated rows with one id are candidates each, and a query never
finds a row of its own id; equal rows of a query are asked once, and a query id with several vectors has the k best of
what all of them find; ties go to the smaller id; an empty table, or no query, gives no rows; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, ship_package
from .vectors import matrix, vector_rows

SHARD_ROWS = 16_384
QUERY_BLOCK = 4_096
LEAF_ROWS = 256
#: How much the triangle inequality's bound is stretched before it is held against the k-th best distance.
FACTOR = 4.0
FOUND = "query_id long, vec_id long, score double"


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, the same for a row whatever rows stand beside it."""
    difference = rows - point
    return np.sqrt((difference * difference).sum(axis=-1))


class VantagePointTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.leaf_rows, self.compared = leaf_rows, 0
        self.random = np.random.default_rng(len(ids))
        self.root = self._build(np.arange(len(ids)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf_rows:
            return members
        vantage = members[self.random.integers(len(members))]
        d = distances(self.rows[members], self.rows[vantage])
        by_distance = np.argsort(d, kind="stable")  # halves by rank, so equal distances split as well
        half = len(members) // 2
        inner, outer = by_distance[:half], by_distance[half:]
        return (vantage, (d[inner[0]], d[inner[-1]]), (d[outer[0]], d[outer[-1]]),
                self._build(members[inner]), self._build(members[outer]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0):
        """(ids, distances) of each query's k nearest rows, padded with -1 and infinity."""
        n = len(queries)
        self.best_d, self.best_id = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        self.query_ids, self.queries, self.k, self.factor = query_ids, queries, k, factor
        self.query_sizes, self.row_sizes = ((x * x).sum(axis=1) for x in (queries, self.rows))
        if len(self.ids) and n:
            self._visit(self.root, np.arange(n))
        return self.best_id, self.best_d

    def _visit(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            self._offer(node, asked)
            return
        vantage, inner_range, outer_range, inner, outer = node
        d = distances(self.queries[asked], self.rows[vantage])
        self.compared += len(asked)
        inside = d - inner_range[1] <= outer_range[0] - d
        for near, far, far_range, group, at in ((inner, outer, outer_range, asked[inside], d[inside]),
                                                (outer, inner, inner_range, asked[~inside], d[~inside])):
            self._visit(near, group)
            bound = np.maximum(np.maximum(far_range[0] - at, at - far_range[1]), 0.0)
            # a hair's breadth for rounding: equal distances are still looked at, as ids decide them
            self._visit(far, group[bound * self.factor <= self.best_d[group, -1] * (1 + 1e-12)])

    def _offer(self, members: np.ndarray, asked: np.ndarray) -> None:
        """Hold the members of a leaf against each query's best.  A matrix product sorts out most of them; only what
        is within rounding of the k-th best is measured exactly."""
        k, q, r = self.k, self.queries[asked], self.rows[members]
        self.compared += len(asked) * len(members)
        size = self.query_sizes[asked][:, None] + self.row_sizes[members]
        squared = size - 2.0 * (q @ r.T)
        squared[self.ids[members] == self.query_ids[asked][:, None]] = np.inf
        limit = self.best_d[asked, -1] ** 2
        if len(members) > k:
            open_still = np.flatnonzero(np.isinf(limit))
            limit[open_still] = np.partition(squared[open_still], k - 1, axis=1)[:, k - 1]
        who, what = np.nonzero(squared <= limit[:, None] + 1e-9 * size)
        keep = ~np.isinf(squared[who, what])
        who, what = who[keep], what[keep]
        if not len(who):
            return
        touched, place = np.unique(who, return_inverse=True)
        rows = asked[touched]
        d = np.concatenate([self.best_d[rows].ravel(), distances(r[what], q[who])])
        ids = np.concatenate([self.best_id[rows].ravel(), self.ids[members[what]]])
        owner = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        order = np.lexsort((ids, d, owner))
        starts = np.searchsorted(owner[order], np.arange(len(rows)))
        first = order[starts[:, None] + np.arange(k)]
        self.best_d[rows], self.best_id[rows] = d[first], ids[first]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = FACTOR, key: str = "vec_id",
            vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` (a condition on
    ``vec_id``) holds, among all other rows."""
    ship_package(vectors.sparkSession)
    rows = vector_rows(vectors, key, vector)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    of_one_id = Window.partitionBy("embedding", "vec_id").orderBy("nth")
    kept = (rows.withColumn("nth", F.dense_rank().over(copies)).where(F.col("nth") <= k + 1)
            .withColumn("row", F.row_number().over(of_one_id)).where(F.col("row") <= k).drop("nth", "row"))
    kept = materialise(kept, "candidates")
    queries = rows.where(is_query).distinct()
    shards = max(1, -(-kept.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_block))
    hashed = F.xxhash64("vec_id", F.lit("shard"))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    candidates = kept.select(F.pmod(hashed, F.lit(shards)).alias("shard"), every(blocks).alias("block"), "vec_id",
                             "embedding")
    asked = queries.select(every(shards).alias("shard"), F.pmod(hashed, F.lit(blocks)).alias("block"), "vec_id",
                           "embedding")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if not (candidates.num_rows and asked.num_rows):
            return out[0]
        lengths = [np.asarray(pa.compute.list_value_length(t["embedding"])) for t in (candidates, asked)]
        for length in np.unique(lengths[1]):
            of = [t.filter(pa.array(n == length)) for t, n in zip((candidates, asked), lengths)]
            if not of[0].num_rows:
                continue
            tree = VantagePointTree(of[0]["vec_id"].to_numpy(), matrix(of[0]["embedding"]))
            query_ids = of[1]["vec_id"].to_numpy()
            ids, d = tree.search(query_ids, matrix(of[1]["embedding"]), k, factor)
            found = ~np.isinf(d)
            out.append(pa.table([np.repeat(query_ids, found.sum(axis=1)), ids[found], d[found]], schema=schema))
        return pa.concat_tables(out)

    found = (candidates.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInArrow(search, FOUND))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
