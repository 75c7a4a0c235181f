"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the operators assume. They go into a session that is built here; a
# session that exists keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "crease",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session as it is, or build one (tests and local runs)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``, used as it is.

    Only where it is unset and the session runs in one process (``local``
    master: tests, trials) a scratch folder is made, and removed at the end; on
    a cluster an unset folder is an error, as executors share no local disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="crease-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


#: Files a task of a shuffle writes side by side, without sorting its rows (``spark.shuffle.sort.bypassMergeThreshold``).
UNSORTED_PARTITIONS = 200


def partitions_for(spark: SparkSession, rows: int, few: int, many: int) -> int | None:
    """How many partitions to deal ``rows`` into, so that a task's share does not grow with the table: shares of ``few``
    rows up to ``UNSORTED_PARTITIONS``, of no more than ``many`` beyond. None leaves the number to Spark, where its
    tasks are enough for shares of ``few``."""
    wanted = max(min(UNSORTED_PARTITIONS, -(-rows // few)), -(-rows // many))
    return wanted if wanted > spark.sparkContext.defaultParallelism else None


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: Spark copies it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        made = tempfile.mkdtemp(prefix="crease-package-")  # the driver serves the file from here to the end
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        shutil.copytree(root, f"{made}/staged/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{made}/{root.name}", "zip", f"{made}/staged"))
        _shipped.add(sc.applicationId)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The input is persisted first: writing a reliable checkpoint is a second
    job over the same data, which would otherwise recompute it.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    if not eager:
        return df.checkpoint(eager=False)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out
