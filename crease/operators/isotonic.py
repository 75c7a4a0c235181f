"""Isotonic regression by merging stacks of pools, and its application as a range join.

Pooling adjacent violators is associative: the pools of a range of scores are all that is needed of it, and pooling the
pools of neighbouring ranges gives the pools of both. So rows are first counted by distinct score; every range of scores
is pooled by itself; then ``FAN_IN`` neighbouring ranges at a time are merged, until one is left. Pools with equal means
are joined too. For labels 0 and 1 there can then be no more pools than strictly rising fractions with so many rows, about
n^(2/3), and usually there are far fewer; only they move.

The fit is a table of pools, not an object on the driver. A score takes the value of its pool, the linear interpolation
between two pools it lies between, or the value of the first or last pool outside of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.operators.ordered import CELLS, splitters, with_cell
from crease.session import ship_package
from crease.sources.sinks import scratch_path

#: Ranges that are merged into one in a round.
FAN_IN = 16

POOLS = "part long, lo double, hi double, weight double, total double"


@dataclass
class IsotonicModel:
    """``pools`` (lo, hi, value), a written table; ascending in all columns."""

    pools: DataFrame


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pools of each part, of rows (POOLS) sorted by part and ``lo``; parts are numbered for the next round."""
    def give(part: int, stack: list[list[float]]) -> pa.RecordBatch:
        columns = [pa.array([part // FAN_IN] * len(stack), pa.int64()),
                   *(pa.array(c, pa.float64()) for c in zip(*stack))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "lo", "hi", "weight", "total"])

    part, stack = None, []
    for batch in batches:
        for of, lo, hi, weight, total in zip(*(c.to_pylist() for c in batch.columns)):
            if of != part:
                if stack:
                    yield give(part, stack)
                part, stack = of, []
            # as long as the pool before does not lie under this one, they are one
            while stack and stack[-1][3] * weight >= total * stack[-1][2]:
                before = stack.pop()
                lo, weight, total = before[0], before[2] + weight, before[3] + total
            stack.append([lo, hi, weight, total])
    if stack:
        yield give(part, stack)


def isotonic_fit(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba") -> IsotonicModel:
    """Non-decreasing least-squares fit of ``y`` on ``p``; rows with a missing score or label are left out."""
    spark = df.sparkSession
    ship_package(spark)
    score, label = F.col(p).cast("double"), F.col(y).cast("double")
    points = df.where(score.isNotNull() & ~F.isnan(score) & label.isNotNull()).groupBy(score.alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(label).alias("total"))
    cut = with_cell(points, "lo", splitters(points, "lo"), "part").select(
        F.col("part").cast("long").alias("part"), "lo", F.col("lo").alias("hi"), "weight", "total")
    parts = CELLS
    while True:
        pooled = cut.repartition("part").sortWithinPartitions("part", "lo").mapInArrow(_pool, POOLS)
        path = scratch_path(spark, "pools")
        pooled.write.parquet(path)
        cut = spark.read.schema(pooled.schema).parquet(path)
        if parts == 1:
            return IsotonicModel(cut.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value")))
        parts = -(-parts // FAN_IN)


def isotonic_apply(df: DataFrame, model: IsotonicModel, p: str = "y_pred_proba",
                   out: str = "y_pred_calibrated") -> DataFrame:
    """``df`` with the fitted value of each score, null for a missing one or an empty fit.

    A range join on the pools' borders: distinct scores and pools are cut into the same cells, and each score takes the
    last pool of its cell that begins at or before it. Cells are cut where pools begin, so there is one in each but the
    first, where scores may lie under all pools; these take the first pool's value."""
    pools = model.pools
    splits = splitters(pools, "lo")
    cells = with_cell(pools, "lo", splits).withColumn("pool", F.struct("lo", "hi", "value"))
    firsts = cells.groupBy("_cell").agg(F.min("pool").alias("first"))  # at most CELLS rows
    after = firsts.select("_cell", F.lead("first").over(Window.orderBy("_cell")).alias("after"))
    within = Window.partitionBy("_cell").orderBy("lo")
    followed = (cells.join(F.broadcast(after), "_cell")
                .withColumn("next", F.coalesce(F.lead("pool").over(within), F.col("after"))))
    known = F.struct("lo", "hi", "value", F.col("next.lo").alias("next_lo"), F.col("next.value").alias("next_value"))
    starts = followed.select("_cell", F.col("lo").alias("at"), F.lit(0).alias("kind"), known.alias("known"))
    score = F.col(p).cast("double")
    asked = df.select(score.alias("at")).where(score.isNotNull() & ~F.isnan(score)).distinct()
    placed = with_cell(asked, "at", splits).select("_cell", "at", F.lit(1).alias("kind"),
                                                   F.lit(None).cast(starts.schema["known"].dataType).alias("known"))
    # a score comes after the pool that begins with it
    before = Window.partitionBy("_cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(placed).withColumn("known", F.last("known", ignorenulls=True).over(before)) \
        .where("kind = 1").select("at", "known")
    least = pools.agg(F.min_by("value", "lo").alias("value")).scalar()
    fitted = found.select(F.col("at").alias("_at"), F.coalesce(_value(F.col("at"), F.col("known")), least).alias(out))
    return df.withColumn("_score", score).join(fitted, F.col("_score") == F.col("_at"), "left").drop("_score", "_at")


def _value(at: Column, known: Column) -> Column:
    between = known["value"] + (known["next_value"] - known["value"]) * (at - known["hi"]) / (
        known["next_lo"] - known["hi"])
    return F.when(at <= known["hi"], known["value"]).when(known["next_lo"].isNull(), known["value"]).otherwise(between)
