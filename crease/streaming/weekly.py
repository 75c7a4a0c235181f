"""Weekly KPI monitoring as a Structured Streaming query.

The stream keeps one row of sums a week (by probability bin, for the ECE). When the watermark passes a week's end, the
week is closed: its row goes on and leaves the state, so the state is as large as the weeks that are open, however long the
stream runs. Each micro-batch publishes the weeks it closed, once, in a folder of its own, ``epoch=<n>``, which is
written anew if the batch is repeated. A run of weeks over the limit is carried from batch to batch by the last published
week, which knows its length; nothing older is read. Rows that come after their week was closed are dropped; ``late``
says how long a week stays open. The streaming checkpoint makes the query restartable.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crease.operators.calibration import bin_index, uniform_edges
from crease.operators.policy import WEEKLY_MAE_LIMIT, WEEKLY_RUN

WEEKS = ("week_start timestamp, n long, mae double, ece double, mae_breach boolean, run long, alert boolean, "
         "epoch long")


def events_to_scored(events: DataFrame) -> DataFrame:
    """Proxy labels for the event stream: y = purchase, p = value / (value + 50)."""
    ev = events.filter(F.col("value").isNotNull() & F.col("ts").isNotNull() & (F.col("value") + 50 != 0))
    return ev.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("y_true"),
                     F.round(F.col("value") / (F.col("value") + 50), 3).alias("y_pred_proba"))


def closed_weeks(scored: DataFrame, late: str, n_bins: int = 10) -> DataFrame:
    """``week_start, n, mae, ece`` of each Monday-aligned week, once the watermark has passed its end."""
    y, p = F.col("y_true").cast("double"), F.col("y_pred_proba").cast("double")
    place = bin_index("y_pred_proba", uniform_edges(n_bins))

    def gap(b: int) -> Column:
        return F.abs(F.sum(F.when(place == b, y - p).otherwise(0.0)))

    sums = scored.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(y - p)).alias("error"),
        sum((gap(b) for b in range(1, n_bins)), gap(0)).alias("gaps"))
    return sums.select(F.col("w.start").alias("week_start"), "n", (F.col("error") / F.col("n")).alias("mae"),
                       (F.col("gaps") / F.col("n")).alias("ece"))


def with_runs(weeks: DataFrame, before: DataFrame | None, limit: float = WEEKLY_MAE_LIMIT,
              run: int = WEEKLY_RUN) -> DataFrame:
    """``mae_breach``, the ``run`` of weeks in a row over the limit that a week ends, and ``alert`` if it is long enough.
    ``before`` is the week (one row at most) that was published last. One row a week, so the ordered windows are small."""
    new = weeks.select("week_start", "n", "mae", "ece", (F.col("mae") > limit).alias("mae_breach"),
                       F.lit(1).cast("long").alias("length"), F.lit(True).alias("new"))
    if before is not None:
        new = new.unionByName(before.select("week_start", "n", "mae", "ece", "mae_breach", F.col("run").alias("length"),
                                            F.lit(False).alias("new")))
    in_order = Window.orderBy("week_start")
    goes_on = F.lag("mae_breach").over(in_order) & (
        F.lag("week_start").over(in_order) == F.col("week_start") - F.expr("INTERVAL 7 DAYS"))
    begun = new.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    numbered = begun.withColumn("number", F.sum("begins").over(in_order))
    so_far = F.sum("length").over(Window.partitionBy("number").orderBy("week_start"))
    counted = numbered.withColumn("run", F.when(F.col("mae_breach"), so_far).otherwise(0).cast("long"))
    return counted.where("new").select("week_start", "n", "mae", "ece", "mae_breach", "run",
                                       (F.col("run") >= run).alias("alert"))


def start_weekly_monitor(spark: SparkSession, source: str, schema, output_path: str, checkpoint_location: str,
                         to_scored: Callable[[DataFrame], DataFrame] = events_to_scored, available_now: bool = True,
                         n_bins: int = 10, late: str = "1 day", limit: float = WEEKLY_MAE_LIMIT, run: int = WEEKLY_RUN,
                         files_per_trigger: int = 1_000) -> StreamingQuery:
    """Publish each closed week of the Parquet files in ``source`` under ``output_path``, once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    spark.createDataFrame([], WEEKS).drop("epoch").write.mode("ignore").parquet(f"{output_path}/epoch=-1")

    def publish(batch: DataFrame, epoch_id: int) -> None:
        published = latest(spark, output_path, with_epoch=True).where(F.col("epoch") < epoch_id)
        before = spark.createDataFrame(published.orderBy(F.desc("week_start")).limit(1).collect(), WEEKS)
        with_runs(batch, before, limit, run).write.mode("overwrite").parquet(f"{output_path}/epoch={epoch_id}")

    writer = closed_weeks(to_scored(stream), late, n_bins).writeStream.outputMode("append").foreachBatch(publish) \
        .option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest(spark: SparkSession, output_path: str, with_epoch: bool = False) -> DataFrame:
    """The weeks that have been closed so far."""
    weeks = spark.read.schema(WEEKS).parquet(output_path)
    return weeks if with_epoch else weeks.drop("epoch")
