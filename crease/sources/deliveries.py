"""Delivery sources: file scans (CSV / Parquet) and the lineitem-derived fixture."""

from __future__ import annotations

import hashlib
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from crease.plans.fixtures import DELIVERY_CTES, DIRTY_SELECT, WINNERS_SELECT
from crease.schema import COLUMN_ALIASES, DELIVERY_SCHEMA

# Fixed value: how the first line of a placeholder file begins, in lower case.
LFS_POINTER_PREFIX = "version https://git-lfs.github.com/spec/"


class DataUnavailableError(RuntimeError):
    """Raised when the delivery file is a placeholder or holds no rows."""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reject_pointer_file(spark: SparkSession, path: str) -> None:
    """Refuse a text file whose first line is a Git-LFS pointer.

    Reads only the first line (``limit(1)`` on a text scan stops after one row).
    """
    first = spark.read.text(path).limit(1).collect()
    if first and (first[0][0] or "").strip().lower().startswith(LFS_POINTER_PREFIX):
        raise DataUnavailableError(f"{path} holds a pointer to the deliveries, not the deliveries")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns a CSV writer left behind (``Unnamed: 0`` ...)."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])


def delivery_schema(columns: Iterable[str]) -> T.StructType:
    """Types of a delivery file's columns by their (alias) names."""
    types = {f.name: f.dataType for f in DELIVERY_SCHEMA}
    named = {alias: types[canonical] for canonical, aliases in COLUMN_ALIASES.items() for alias in aliases
             if canonical in types}
    # positions such as "6.1" are read as they stand
    named |= {"ball": T.StringType(), "ball_no": T.StringType()}
    return T.StructType([T.StructField(c, named.get(c, types.get(c, T.StringType()))) for c in columns])


def scan_deliveries(spark: SparkSession, path: str, fmt: str = "csv", schema=None,
                    check_empty: bool = True, **options) -> DataFrame:
    """Read a delivery file.

    ``fmt`` is ``csv`` (header row expected) or any other format Spark reads. A CSV
    without a ``schema`` takes its types from the column names: those of
    ``DELIVERY_SCHEMA`` for canonical names and their aliases, text for others —
    no inference, which on a large file is a full extra pass. Text of the
    wrong type is read as null. Extra ``options`` go to the reader.
    ``check_empty`` is a one-row probe, not a count.
    """
    reader = spark.read.options(**options)
    if fmt == "csv":
        reject_pointer_file(spark, path)
        reader = reader.option("header", "true")
        schema = schema if schema is not None else delivery_schema(reader.csv(path).columns)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    df = drop_unnamed(df)
    if check_empty and df.isEmpty():
        raise DataUnavailableError(f"{path} has no deliveries")
    return df


def _fixture(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    view = "crease_lineitem_" + hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView(view)
    return spark.sql("WITH " + DELIVERY_CTES.format(lineitem=view) + select)


def fixture_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries derived from ``lineitem`` (one ball per row), raw alias names."""
    return _fixture(spark, sf_dir, " SELECT * FROM raw_deliveries")


def fixture_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``match_id, winner`` of ``fixture_deliveries``, one row per match; no ball is moved for it."""
    return _fixture(spark, sf_dir, WINNERS_SELECT)


def dirty_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deliveries as files carry them: dates in several formats, numbers as text with ``NaN`` and junk,
    seasons such as ``2007/08``."""
    return _fixture(spark, sf_dir, DIRTY_SELECT)
