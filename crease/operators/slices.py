"""Error slices, drift summaries and failure analysis."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.expressions import matchup_key
from crease.operators.metrics import LOG_LOSS_EPS
from crease.operators.ordered import prefix_sums, splitters


def slice_metrics(df: DataFrame, slice_col: str, y: str = "y_true", yhat: str = "y_pred",
                  p: str = "y_pred_proba", min_samples: int = 10) -> DataFrame:
    """Per slice value: n, accuracy, ROC AUC, log loss, positive rate; null slices
    and slices under ``min_samples`` rows are dropped; a single class gives null
    AUC and log loss.

    All of them come from one table of counts per (slice, distinct score)."""
    d = df.filter(F.col(slice_col).isNotNull())
    yv = F.col(y).cast("double")
    scores = d.groupBy(slice_col, F.col(p).cast("double").alias("score")).agg(
        F.sum(yv).alias("pos"), F.sum(1 - yv).alias("neg"),
        F.sum((yv == F.col(yhat).cast("double")).cast("double")).alias("correct"))
    ranked = prefix_sums(scores, "score", ["neg"], [slice_col], inclusive=False, splits=splitters(scores, "score"))
    pos, neg, clipped = F.col("pos"), F.col("neg"), F.least(F.greatest("score", F.lit(LOG_LOSS_EPS)),
                                                            F.lit(1 - LOG_LOSS_EPS))
    sums = ranked.groupBy(slice_col).agg(
        F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"), F.sum("correct").alias("_correct"),
        F.sum(pos * -F.log(clipped) + neg * -F.log(1 - clipped)).alias("_loss"),
        F.sum(pos * (F.col("cum_neg") + 0.5 * neg)).alias("_u"))
    n = F.col("_pos") + F.col("_neg")
    two_classes = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return sums.filter(n >= min_samples).select(
        slice_col, n.cast("long").alias("n_samples"), (F.col("_correct") / n).alias("accuracy"),
        F.when(two_classes, F.col("_u") / (F.col("_pos") * F.col("_neg"))).alias("roc_auc"),
        F.when(two_classes, F.col("_loss") / n).alias("log_loss"), (F.col("_pos") / n).alias("positive_rate"))


def slice_by_season(df: DataFrame, season: str = "season", **kw) -> DataFrame:
    return slice_metrics(df, season, min_samples=5, **kw)


def slice_by_venue(df: DataFrame, venue: str = "venue", **kw) -> DataFrame:
    return slice_metrics(df, venue, min_samples=10, **kw)


def slice_by_matchup(df: DataFrame, team: str = "team", opponent: str | None = None, **kw) -> DataFrame:
    """By unordered team pair (min 5 rows) when an opponent column exists, else by team (min 10)."""
    if opponent and opponent in df.columns:
        return slice_metrics(df.withColumn("matchup", matchup_key(team, opponent)), "matchup", min_samples=5, **kw)
    return slice_metrics(df, team, min_samples=10, **kw)


def drift_first_last(season_metrics: DataFrame, metrics: Sequence[str] = ("accuracy", "roc_auc", "log_loss"),
                     season: str = "season") -> DataFrame:
    """Per metric: first and last season value (ordered by season, quirk Q18),
    change, % change (first 0 -> 0), mean and trend."""
    long = season_metrics.select(season, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")) \
        .select(season, "m.metric", "m.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    agg = long.groupBy("metric").agg(
        F.min(season).alias("first_season"), F.max(season).alias("last_season"),
        F.min_by("value", F.col(season)).alias("first_value"), F.max_by("value", F.col(season)).alias("last_value"),
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_seasons"))
    change = F.col("last_value") - F.col("first_value")
    return agg.filter(F.col("n_seasons") > 1).select(
        "metric", "first_season", "last_season", "first_value", "last_value", change.alias("change"),
        F.when(F.col("first_value") != 0, change / F.col("first_value") * 100).otherwise(F.lit(0.0)).alias("change_pct"),
        "mean_value", F.when(F.col("last_value") > F.col("first_value"), F.lit("increasing"))
        .otherwise(F.lit("decreasing")).alias("trend"))


def drift_report(season_metrics: DataFrame, season: str = "season") -> DataFrame:
    """Long report ``(kind, season, metric, value, trend)``: the season table plus
    first->last summaries (the reference writes the same facts as Markdown)."""
    metrics = [m for m in ("n_samples", "accuracy", "roc_auc", "log_loss", "positive_rate")
               if m in season_metrics.columns]
    table = season_metrics.select(F.col(season).cast("int").alias("season"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")) \
        .select(F.lit("season").alias("kind"), "season", "m.metric", "m.value", F.lit(None).cast("string").alias("trend"))
    summ = drift_first_last(season_metrics, ("accuracy", "log_loss"), season)
    summary = summ.select(F.lit("change").alias("kind"), F.col("last_season").cast("int").alias("season"), "metric",
                          F.col("change").alias("value"), "trend")
    return table.unionByName(summary)


def top_failures(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", n_top: int = 5,
                 include_features: Sequence[str] | None = None, tiebreak: Sequence[str] = ("rid",)) -> DataFrame:
    """False positives (y=0, p>0.5, highest p) and false negatives (y=1, p<0.5,
    lowest p), ``n_top`` each, with ``error = |y - p|`` and ``failure_type``.
    Each side is a top-k (per-task top-k, then merge), unioned by name."""
    base = ["match_id", "player", "team", "season", y, p]
    cols = [c for c in base + list(include_features or []) if c in df.columns]
    tb = [F.col(c).asc() for c in tiebreak if c in df.columns]
    d = df.withColumn("error", F.abs(F.col(y).cast("double") - F.col(p).cast("double")))
    fp = d.filter((F.col(y) == 0) & (F.col(p) > 0.5)).orderBy(F.col(p).desc(), *tb).limit(n_top)
    fn = d.filter((F.col(y) == 1) & (F.col(p) < 0.5)).orderBy(F.col(p).asc(), *tb).limit(n_top)
    fp = fp.select(*cols, "error", F.lit("false_positive").alias("failure_type"))
    fn = fn.select(*cols, "error", F.lit("false_negative").alias("failure_type"))
    return failure_union(fp, fn)


def failure_union(fp: DataFrame, fn: DataFrame) -> DataFrame:
    return fp.unionByName(fn, allowMissingColumns=True)


def failure_report(failures: DataFrame, team: str = "team") -> DataFrame:
    """Per failure type: number of cases and the team seen most often (reported
    only when it appears more than once; ties -> alphabetical)."""
    counts = failures.groupBy("failure_type", team).agg(F.count(F.lit(1)).alias("team_count"))
    w = Window.partitionBy("failure_type").orderBy(F.col("team_count").desc(), F.col(team).asc())
    top = counts.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
    n = failures.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n_cases"))
    return n.join(top, "failure_type", "left").select(
        "failure_type", F.col("n_cases").cast("long").alias("n_cases"),
        F.when(F.col("team_count") > 1, F.col(team)).alias("top_team"),
        F.when(F.col("team_count") > 1, F.col("team_count")).cast("long").alias("top_team_count"))
