"""Sinks: CSV / JSON writers for manifests, slices, failures and summaries.

Paths default to a fresh folder under the shared checkpoint directory
(``spark.checkpoint.dir``), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/out-{name}-{uuid.uuid4().hex[:10]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch_path``, on whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _one_file(df: DataFrame) -> DataFrame:
    """One partition for a small report. ``repartition``, not ``coalesce``: the rows are computed in parallel and only
    their result is brought together."""
    return df.repartition(1)


def write_csv(df: DataFrame, path: str | None, name: str = "table", single_file: bool = False) -> str:
    """Write with a header. ``single_file`` makes one part — only for small report tables."""
    path = path or scratch_path(df.sparkSession, name)
    out = _one_file(df) if single_file else df
    out.write.mode("overwrite").option("header", "true").csv(path)
    return path


def read_csv_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_slice_csv(slices: DataFrame, path: str | None) -> str:
    return write_csv(slices, path, "slices", single_file=True)


def write_failures_csv(failures: DataFrame, path: str | None) -> str:
    return write_csv(failures, path, "failures", single_file=True)


def write_json(df: DataFrame, path: str | None, name: str = "summary", single_file: bool = False) -> str:
    path = path or scratch_path(df.sparkSession, name)
    out = _one_file(df) if single_file else df
    out.write.mode("overwrite").json(path)
    return path


def export_summary(metrics: Mapping[str, float | None], batter_labels: DataFrame, bowler_labels: DataFrame,
                   path: str | None = None) -> str:
    """The run's summary as JSON lines ``(section, key, value)``: the model's metrics and the archetypes' labels."""
    spark = batter_labels.sparkSession
    rows = [("model_metrics", k, None if v is None else repr(round(float(v), 6))) for k, v in metrics.items()]
    table = spark.createDataFrame(rows, "section string, key string, value string")
    for section, labels in (("cluster_labels.batters", batter_labels), ("cluster_labels.bowlers", bowler_labels)):
        table = table.unionByName(labels.select(F.lit(section).alias("section"),
                                                F.col("cluster").cast("string").alias("key"),
                                                F.col("label").alias("value")))
    return write_json(table, path, "summary", single_file=True)
