"""Interval join on a table of bands: the first band that holds a value wins.

A band holds the values from ``low`` up to ``high``, and ``high`` itself if it is closed. Bands may overlap; of those that
hold a value, the one with the smallest ``position`` wins. The table is first swept once, in order of ``low``, into
segments that no two bands share, so a row matches one segment at most and nothing has to be decided per row.

A counted small table of segments is broadcast. A larger one is bucketed: segments are listed under each cell of values
they reach into (``ordered.with_cell``), and rows are joined by cell; adaptive execution splits cells with many rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crease.operators.ordered import splitters, with_cell
from crease.session import ship_package
from crease.sources.sinks import scratch_path

#: Segments up to which the table is broadcast.
BROADCAST_SEGMENTS = 2_000

#: Borders on the line of values: just before a value (0) or just after it (1).
SEGMENT = "group string, number long, first double, after_first int, last double, after_last int"


def sweep(bands: Iterator[tuple[tuple, tuple, int]]) -> Iterator[tuple[tuple, tuple, int]]:
    """Disjoint segments (start, end, band) of bands (start, end, rank) in the order of their starts; the smallest rank
    wins. A segment does not hold its end."""
    active: list[tuple[int, tuple]] = []
    at, held = None, None

    def up_to(stop: tuple | None) -> Iterator[tuple[tuple, tuple, int]]:
        nonlocal at, held
        while active and (stop is None or at < stop):
            rank, end = active[0]
            if end <= at:
                heapq.heappop(active)
                continue
            here = end if stop is None else min(end, stop)  # a better band can only begin at the next start
            if held and held[1] == at and held[2] == rank:
                held = (held[0], here, rank)
            else:
                if held:
                    yield held
                held = (at, here, rank)
            at = here
        at = stop

    for start, end, rank in bands:
        if start < end:
            if at is not None:
                yield from up_to(start)
            at = start
            heapq.heappush(active, (rank, end))
    if at is not None:
        yield from up_to(None)
    if held:
        yield held


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of rows (group, number, low, high, closed) sorted by group and ``low``."""
    def rows() -> Iterator[tuple[str, tuple]]:
        for batch in batches:
            for group, number, low, high, closed in zip(*(c.to_pylist() for c in batch.columns)):
                yield group, ((low, 0), (high, int(closed)), number)

    def give(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    real, whole = pa.float64(), pa.int32()
    schema = pa.schema([("group", pa.string()), ("number", pa.int64()), ("first", real), ("after_first", whole),
                        ("last", real), ("after_last", whole)])
    for group, part in groupby(rows(), key=lambda row: row[0]):
        found = []
        for start, end, rank in sweep(band for _, band in part):
            found.append((group, rank, *start, *end))
            if len(found) >= 10_000:
                yield give(found)
                found = []
        if found:
            yield give(found)


def first_match(df: DataFrame, value: str, bands: DataFrame, by: str | None = None,
                keep: Sequence[str] = ("label",), broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """``df`` with the columns ``keep`` of the first band that holds ``value``, null where none does.

    ``bands`` has ``low, high, closed, position`` and ``keep``; with ``by`` (a text column) it holds several tables
    of bands, and each row comes once for every one of them. Bands without a low or high end, and values that are
    missing, match nothing."""
    spark = df.sparkSession
    ship_package(spark)
    group = F.col(by).cast("string") if by else F.lit("")
    nth = Window.partitionBy("_group").orderBy("position", "low", "high")
    numbered = bands.select("*", group.alias("_group")).where("low IS NOT NULL AND high IS NOT NULL").withColumn(
        "_number", F.row_number().over(nth).cast("long"))
    ordered = (numbered.select(F.col("_group").alias("group"), F.col("_number").alias("number"),
                               F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "closed")
               .repartition("group").sortWithinPartitions("group", "low"))
    path = scratch_path(spark, "segments")
    ordered.mapInArrow(_segments, SEGMENT).write.parquet(path)
    segments = spark.read.schema(SEGMENT).parquet(path)
    small = segments.limit(broadcast_segments + 1).count() <= broadcast_segments

    v = F.col("_value")
    rows = df.withColumn("_value", F.nullif(F.col(value).cast("double"), F.lit(float("nan"))))
    if by:
        groups = numbered.select(F.col("_group").alias("_of")).distinct()
        rows = rows.join(F.broadcast(groups), how="cross")  # one row a table of bands: the fan-out that is asked for
    else:
        rows = rows.withColumn("_of", F.lit(""))
    holds = ((v > F.col("first")) | ((v == F.col("first")) & (F.col("after_first") == 0))) & (
        (v < F.col("last")) | ((v == F.col("last")) & (F.col("after_last") == 1)))
    payload = numbered.select(F.col("_group").alias("group"), F.col("_number").alias("number"), *keep)
    found = segments.join(payload, ["group", "number"])
    same = F.col("_of") == F.col("group")
    if small:
        joined = rows.join(F.broadcast(found), same & holds, "left")
    else:
        splits = splitters(segments, "first")
        cut = with_cell(with_cell(found, "first", splits, "_from"), "last", splits, "_to")
        listed = cut.withColumn("_cell", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
        joined = with_cell(rows, "_value", splits, "_place").join(
            listed, same & (F.col("_place") == F.col("_cell")) & holds, "left").drop("_place", "_cell")
    out = joined.drop("_value", "group", "number", "first", "after_first", "last", "after_last")
    return out.withColumnRenamed("_of", by) if by else out.drop("_of")
