import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from crease.operators.policy import weekly_kpi, weekly_kpi_breach
from crease.sources.sinks import scratch_path
from crease.streaming.weekly import events_to_scored, latest, start_weekly_monitor

SF = "/root/testdata/sf0.001"
SCORED = "ts timestamp, y_true int, y_pred_proba double"


def weeks(df):
    return {r.week_start: (r.n, round(r.mae, 9), round(r.ece, 9), r.mae_breach, r.alert) for r in df.collect()}


def run(spark, source, schema, out, checkpoint, **options):
    query = start_weekly_monitor(spark, source, schema, out, checkpoint, **options)
    query.awaitTermination(180)
    assert query.exception() is None
    return query.lastProgress


@pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="test data not present")
def test_stream_matches_batch(spark):
    src = spark.read.parquet(f"{SF}/events.parquet")
    staged = scratch_path(spark, "events-src")
    # one event far later closes all weeks but its own
    end = src.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 60 DAYS"), "value": F.lit(1.0)})
    src.unionByName(end.select(*[F.col(c).cast(src.schema[c].dataType).alias(c) for c in src.columns])).write.parquet(staged)
    out = scratch_path(spark, "weekly")
    run(spark, staged, src.schema, out, scratch_path(spark, "weekly-ckpt"))
    want = weeks(weekly_kpi_breach(weekly_kpi(events_to_scored(src))))
    assert weeks(latest(spark, out)) == want and len(want) > 0


def test_late_rows_gaps_restarts_and_the_size_of_the_state(spark):
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for week in range(14):
        if week != 6:  # a gap ends a run
            for _ in range(30):
                off = 0.5 if week not in (2, 9) else 0.02  # weeks 2 and 9 are under the limit
                y = draw.randint(0, 1)
                rows.append((start + dt.timedelta(days=7 * week, minutes=draw.randint(0, 7 * 1440 - 1)), y, abs(y - off)))
    rows.sort()
    # within a day of the newest row, rows may come in any order; some come too late and are not counted
    shuffled = sorted(rows, key=lambda r: r[0] + dt.timedelta(hours=draw.randint(0, 20)))
    lost = [(start + dt.timedelta(days=1), 1, 0.0)] * 5
    source, out, checkpoint = (scratch_path(spark, n) for n in ("late-src", "late-out", "late-ckpt"))
    schema = spark.createDataFrame([], SCORED).schema
    parts = [shuffled[:100], shuffled[100:250], [*lost, *shuffled[250:]],
             [(start + dt.timedelta(days=7 * 30), 0, 0.5)]]
    sizes = []
    for i, part in enumerate(parts):  # the query ends and starts again between the parts
        spark.createDataFrame(part, SCORED).coalesce(1).write.mode("append").parquet(source)
        progress = run(spark, source, schema, out, checkpoint, to_scored=lambda df: df, files_per_trigger=1)
        sizes.append([op["numRowsTotal"] for op in progress["stateOperators"]])
    batch = weekly_kpi_breach(weekly_kpi(spark.createDataFrame(rows, SCORED)))
    found = weeks(latest(spark, out))
    assert found == weeks(batch) and len(found) == 13
    assert any(v[4] for v in found.values()) and not all(v[4] for v in found.values())
    # only open weeks are kept, and each is published once
    assert all(sum(size) <= 3 for size in sizes) and latest(spark, out).count() == 13
