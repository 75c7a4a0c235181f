"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names, and size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.session import checkpoint_dir, ship_package

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 500_000


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path under the checkpoint folder; nothing is created yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/crease-{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it is computed once, and losing an
    executor loses none of it."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (an intermediate table) has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of ``df`` with the one-column table ``ids``.  The ids are broadcast if there are few, so
    ``df`` is not shuffled; beyond that it is a shuffle join, which adaptive execution splits at hot keys."""
    side = F.broadcast(ids) if small_enough(ids) else ids
    return df.join(side, key, how)


def scan(spark: SparkSession, sf_dir: str, table: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
