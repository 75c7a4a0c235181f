"""Connected components of a table of links, by alternating stars, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, materialise

EDGES = "u long, v long"


class Forest:
    """Union-find over ids; a root is the smallest id of its tree."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


#: Nodes a task's forest may hold before its stars are given out and it starts anew.
FOREST_NODES = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: same components, at most one link a node."""
    def give(forest: Forest) -> pa.RecordBatch:
        stars = np.array(forest.stars(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["u", "v"])

    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(x, y)
        if len(forest.parent) > FOREST_NODES:
            yield give(forest)
            forest = Forest()
    yield give(forest)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest id reachable) for the nodes of ``links`` (two long columns) whose component
    holds a smaller id; all others are their own component.

    Each partition first contracts its links; then large and small stars alternate until nothing changes, a number of
    rounds that grows with the logarithm of the longest path.  A node with very many links is one hot join key, which
    adaptive execution splits.
    """
    u, v = links.columns
    ends = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    edges = materialise(map_batches(ends.where("u <> v"), _contract, EDGES).distinct(), "links")
    before = None
    while (now := _fingerprint(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        edges = materialise(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
