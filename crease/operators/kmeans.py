"""k-means with restarts over distinct weighted vectors, all restarts stepped together.

Rows with equal features are one vector with a weight, which changes no sum, so every pass reads the distinct vectors
only. The starts of all restarts are drawn at once, one centre a pass, as k-means++ draws them: a vector follows with
a chance in proportion to its squared distance from the nearest centre so far. The draw is a race of exponential
times, -ln(u)/distance², whose smallest wins; u is a portable hash of the vector and the restart, so SQL can repeat it.
A Lloyd step is one pass for all restarts that still move: a task gives out at most restarts × k rows of sums. A restart
has settled when no vector changes its cluster. The one with the least cost wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.expressions import HASH_MOD
from crease.operators.bootstrap import NUMBER_HALVES, portable_uniform
from crease.session import ship_package
from crease.sources.sinks import remove_path, scratch_path

#: Vectors are told apart by the hash to this many parts of one.
UNITS = 1_000_000
#: Salts of a restart's draws.
DRAWS = 64
#: Vectors of one task at least, and rows of sums that may come to the driver without being added up before.
TASK_VECTORS, DRIVER_ROWS = 8_000, 20_000
#: Distances that a task holds at a time.
DISTANCES = 4 << 20


def vector_number(columns: Sequence[Column]) -> list[Column]:
    """Whole numbers that stand for a vector of features."""
    return [F.floor(c.cast("double") * UNITS + 0.5).cast("long") for c in columns]


def numbers_of(parts: np.ndarray) -> np.ndarray:
    """62 bits mixed from rows of whole numbers; integer arithmetic any SQL engine has."""
    halves = [np.ones(len(parts), np.int64) for _ in NUMBER_HALVES]
    for value in parts.T:
        low = value % HASH_MOD
        high = (value // HASH_MOD) % HASH_MOD
        for i, (a, b, c, step, square) in enumerate(NUMBER_HALVES):
            mixed = (halves[i] * a + low * b + high * c + step) % HASH_MOD
            halves[i] = (mixed * mixed + square) % HASH_MOD
    return halves[0] * (1 << 31) + halves[1]


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(vectors, centres), summed feature by feature in order."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j:j + 1] - centres[None, :, j]) ** 2
    return out


class _Part:
    """Vectors of a batch: weight, number, standardised features."""

    def __init__(self, batch: pa.RecordBatch, d: int):
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        self.weight = columns[0].astype(float)
        self.number = columns[1]
        self.x = np.stack(columns[2:], axis=1).astype(float) if d else np.zeros((len(columns[0]), 0))


def _parts(batches: Iterator[pa.RecordBatch], d: int, width: int) -> Iterator[_Part]:
    rows = max(256, DISTANCES // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield _Part(batch.slice(at, rows), d)


def _schema(d: int) -> str:
    return ", ".join(["restart int", "cluster int", "score double", *(f"z{i} double" for i in range(d))])


def _next_centres(points: DataFrame, d: int, centres: np.ndarray, seed: int) -> dict[int, list[float]]:
    """The winner of the next draw of every restart; ``centres`` is (restarts, drawn so far, features)."""
    restarts, drawn, _ = centres.shape

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * restarts
        for part in _parts(batches, d, restarts * max(drawn, 1)):
            u = portable_uniform(part.number, np.arange(restarts) * DRAWS + drawn, seed)
            score = -np.log(np.maximum(u, 1e-12))
            if drawn:
                near = squared_distances(part.x, centres.reshape(-1, d)).reshape(-1, restarts, drawn).min(axis=2)
                score = np.where(near > 0, score / np.where(near > 0, near, 1.0), np.inf)
            for r, at in enumerate(score.argmin(axis=0)):
                found = (float(score[at, r]), *part.x[at].tolist())
                if np.isfinite(found[0]) and (best[r] is None or found < best[r]):
                    best[r] = found
        rows = [(r, 0, *found) for r, found in enumerate(best) if found is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.int32(), pa.int32(), *[pa.float64()] * (d + 1)]
    names = ["restart", "cluster", "score", *(f"z{i}" for i in range(d))]
    found = points.mapInArrow(race, _schema(d)).groupBy("restart").agg(  # one row a restart and task before it
        F.min(F.struct("score", *names[3:])).alias("best"))
    return {r.restart: list(r.best)[1:] for r in found.collect()}


def _step(points: DataFrame, tasks: int, d: int, centres: dict[int, np.ndarray]) -> dict[int, list]:
    """Per restart its rows (cluster, weight, hash of its members, cost, sums)."""
    order = sorted(centres)
    all_centres = np.concatenate([centres[r] for r in order])
    k = len(centres[order[0]])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(order), k, d))
        weight, cost = np.zeros((len(order), k)), np.zeros((len(order), k))
        members = np.zeros((len(order), k), np.int64)
        for part in _parts(batches, d, len(all_centres)):
            far = squared_distances(part.x, all_centres).reshape(-1, len(order), k)
            near = far.argmin(axis=2)
            for i in range(len(order)):
                cluster = near[:, i]
                weight[i] += np.bincount(cluster, part.weight, k)
                cost[i] += np.bincount(cluster, part.weight * far[np.arange(len(cluster)), i, cluster], k)
                # exact whole numbers: 30 bits of the vectors' numbers
                members[i] += np.bincount(cluster, (part.number & 0x3FFFFFFF).astype(float), k).astype(np.int64)
                for j in range(d):
                    sums[i, :, j] += np.bincount(cluster, part.weight * part.x[:, j], k)
        rows = [(order[i], c, weight[i, c], int(members[i, c]), cost[i, c], *sums[i, c])
                for i in range(len(order)) for c in range(k)]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * (d + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["restart", "cluster", "weight", "members", "cost", *(f"z{i}" for i in range(d))]
    schema = ", ".join(["restart int", "cluster int", "weight double", "members long", "cost double",
                        *(f"z{i} double" for i in range(d))])
    total = points.mapInArrow(add_up, schema)
    if tasks * len(order) * k > DRIVER_ROWS:
        total = total.groupBy("restart", "cluster").agg(*(F.sum(c).alias(c) for c in names[2:]))
    sums: dict[tuple[int, int], list] = {}
    for row in total.collect():  # restarts × k, a task or in all
        values = list(row)[2:]
        before = sums.get((row.restart, row.cluster))
        sums[row.restart, row.cluster] = values if before is None else [a + b for a, b in zip(before, values)]
    out: dict[int, list] = {}
    for (restart, cluster), (weight, members, cost, *rest) in sorted(sums.items()):
        out.setdefault(restart, []).append((cluster, weight, members, cost, rest))
    return out


def fit_centres(df: DataFrame, zcols: Sequence[str], keys: Sequence[Column], k: int, restarts: int,
                seed: int = 42) -> tuple[list[list[float]], float]:
    """The centres (standardised, ascending) and the cost of the best of ``restarts`` fits. ``keys`` are whole numbers
    that stand for a row's vector; k is at most the number of distinct vectors."""
    spark = df.sparkSession
    ship_package(spark)
    d = len(zcols)
    distinct = df.groupBy(*zcols).agg(F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(f"k{i}") for i, c in enumerate(keys)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.stack([c.to_numpy() for c in batch.columns[1 + d:]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers_of(parts)), *batch.columns[1:1 + d]],
                                             names=["weight", "number", *(f"z{i}" for i in range(d))])

    chosen = distinct.select("weight", *(F.col(c).alias(f"z{i}") for i, c in enumerate(zcols)),
                             *(f"k{i}" for i in range(len(keys))))
    path = scratch_path(spark, "vectors")
    schema = ", ".join(["weight long", "number long", *(f"z{i} double" for i in range(d))])
    chosen.mapInArrow(number, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    tasks = -(-stored.count() // TASK_VECTORS)
    points = stored.repartition(tasks).persist()

    centres = np.zeros((restarts, 0, d))
    for _ in range(k):
        found = _next_centres(points, d, centres, seed)
        if len(found) < restarts:  # no vector is left that is no centre
            break
        centres = np.concatenate([centres, np.array([found[r] for r in range(restarts)])[:, None]], axis=1)
    moving = {r: centres[r] for r in range(restarts)}
    seen: dict[int, list] = {r: [] for r in moving}
    settled: list[tuple[float, int, np.ndarray]] = []
    while moving:
        for r, rows in _step(points, tasks, d, moving).items():
            members = [(weight, number) for _, weight, number, _, _ in rows]
            new = moving[r].copy()
            for cluster, weight, _, _, sums in rows:
                if weight:  # an empty cluster keeps its centre
                    new[cluster] = np.array(sums) / weight
            # no vector changed its cluster: the centres are their means. (Vectors halfway between centres could go to
            # and fro by rounding; clusters that were there before cost the same.)
            if members in seen[r]:
                settled.append((sum(row[3] for row in rows), r, new))
                del moving[r]
            else:
                seen[r].append(members)
                moving[r] = new
    points.unpersist()
    remove_path(spark, path)
    cost, _, best = min(settled, key=lambda s: s[:2])
    return sorted(best.tolist()), cost
