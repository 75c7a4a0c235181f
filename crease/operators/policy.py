"""Decision policy: probability bands, KPI thresholds and weekly monitoring.

FIXED VALUES — the bands, labels and alert thresholds below are the
reference's documented policy and must stay as written.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.operators.calibration import bin_index, uniform_edges
from crease.operators.intervals import first_match

# (use_case, low, high, label, action) — [low, high), the last band of a use case is closed.
PROBABILITY_BANDS: list[tuple[str, float, float, str, str]] = [
    ("fantasy_picks", 0.00, 0.20, "High Risk Pick", "Consider only for contrarian strategy"),
    ("fantasy_picks", 0.20, 0.40, "Value Pick", "Good risk/reward ratio for differentiation"),
    ("fantasy_picks", 0.40, 0.60, "Toss-up", "Use secondary factors (venue, form) as tiebreaker"),
    ("fantasy_picks", 0.60, 0.80, "Safe Pick", "Recommended for stable lineup"),
    ("fantasy_picks", 0.80, 1.00, "Very Safe Pick", "Core selection for low-variance strategy"),
    ("broadcast_graphics", 0.00, 0.30, "Underdog", "Major underdog"),
    ("broadcast_graphics", 0.30, 0.45, "Slight Underdog", "Slight disadvantage"),
    ("broadcast_graphics", 0.45, 0.55, "Even Match", "Evenly matched"),
    ("broadcast_graphics", 0.55, 0.70, "Favorite", "Slight advantage"),
    ("broadcast_graphics", 0.70, 1.00, "Strong Favorite", "Strong favorite"),
    ("team_strategy", 0.00, 0.40, "Aggressive Strategy", "High-risk tactics, surprise element"),
    ("team_strategy", 0.40, 0.60, "Balanced Strategy", "Standard tactics, adapt to conditions"),
    ("team_strategy", 0.60, 1.00, "Conservative Strategy", "Play to strengths, minimize risks"),
    ("market_analysis", 0.00, 0.35, "Potential Value (if market underestimates)",
     "Check if market odds exceed model probability"),
    ("market_analysis", 0.35, 0.65, "Fair Value", "Market likely efficient in this range"),
    ("market_analysis", 0.65, 1.00, "Potential Value (if market overestimates underdog)",
     "Look for overvalued underdog opportunities"),
]

# (metric, threshold, direction, action): breach when value > threshold ("above")
# or value < threshold ("below").
KPI_ALERTS: list[tuple[str, float, str, str]] = [
    ("expected_calibration_error", 0.08, "above", "Trigger model recalibration"),
    ("roc_auc", 0.65, "below", "Review model and retrain if needed"),
    ("mean_absolute_error", 0.10, "above", "Investigate feature drift or data quality issues"),
    ("precision_at_20", 0.50, "below", "Review upset detection thresholds"),
]

THRESHOLDS = {"upset_detection": 0.40, "high_confidence": 0.75, "low_confidence": 0.25,
              "recalibration_trigger": 0.08}
WEEKLY_MAE_LIMIT = 0.10
WEEKLY_RUN = 3


def use_cases() -> list[str]:
    seen: list[str] = []
    for b in PROBABILITY_BANDS:
        if b[0] not in seen:
            seen.append(b[0])
    return seen


def band_table(spark: SparkSession, bands: Sequence[tuple] = PROBABILITY_BANDS) -> DataFrame:
    """Bands ``(use_case, low, high, label, action)`` as a table; the last one of a use case is closed."""
    last = {b[0]: i for i, b in enumerate(bands)}
    rows = [(case, float(low), float(high), label, action, last[case] == i, i)
            for i, (case, low, high, label, action) in enumerate(bands)]
    return spark.createDataFrame(rows, "use_case string, low double, high double, band string, action string, "
                                       "closed boolean, position long")


def policy_band_join(df: DataFrame, p: str = "y_pred_proba", cases: Sequence[str] | None = None,
                     bands: DataFrame | None = None) -> DataFrame:
    """One row per input row and use case with the band label and action (``intervals.first_match``).

    ``bands`` has ``use_case, low, high, closed, position, band, action``; by default it is the documented policy."""
    bands = bands if bands is not None else band_table(df.sparkSession)
    if cases is not None:
        bands = bands.where(F.col("use_case").isin(*cases))
    return first_match(df, p, bands, by="use_case", keep=("band", "action")).select(
        *df.columns, "use_case", "band", "action")


def alert_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KPI_ALERTS, "metric string, threshold double, direction string, action string")


def kpi_alerts(metrics: DataFrame) -> DataFrame:
    """``(metric, value)`` rows checked against the alert thresholds (4-row table, broadcast)."""
    t = F.broadcast(alert_table(metrics.sparkSession))
    j = metrics.join(t, "metric", "inner")
    breached = F.when(F.col("direction") == "above", F.col("value") > F.col("threshold")) \
        .otherwise(F.col("value") < F.col("threshold"))
    return j.select("metric", "value", "threshold", "direction", F.coalesce(breached, F.lit(False)).alias("breached"),
                    "action")


def weekly_bins(df: DataFrame, ts: str = "ts", y: str = "y_true", p: str = "y_pred_proba",
                n_bins: int = 10) -> DataFrame:
    """Per (Monday-aligned week, probability bin): n, Σy, Σp, Σ|y−p|.

    ``window(ts, '7 days', startTime='4 days')`` aligns to Mondays; this one
    aggregate is all a streaming query has to keep as state."""
    wk = F.window(F.col(ts), "7 days", startTime="4 days")
    b = bin_index(p, uniform_edges(n_bins))
    return df.groupBy(wk.alias("w"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("sy"),
        F.sum(F.col(p).cast("double")).alias("sp"),
        F.sum(F.abs(F.col(y).cast("double") - F.col(p).cast("double"))).alias("sae"))


def rollup_weekly(per_bin: DataFrame) -> DataFrame:
    """Weekly n, MAE and ECE from the per-bin sums."""
    return per_bin.groupBy(F.col("w.start").alias("week_start")).agg(
        F.sum("n").alias("n"), (F.sum("sae") / F.sum("n")).alias("mae"),
        (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"))


def weekly_kpi(df: DataFrame, ts: str = "ts", y: str = "y_true", p: str = "y_pred_proba",
               n_bins: int = 10) -> DataFrame:
    """Weekly (Monday-aligned) MAE and ECE of a batch frame."""
    return rollup_weekly(weekly_bins(df, ts, y, p, n_bins))


def weekly_kpi_breach(weekly: DataFrame, limit: float = WEEKLY_MAE_LIMIT, run: int = WEEKLY_RUN) -> DataFrame:
    """Flag weeks closing a run of ``run`` consecutive weeks with MAE above ``limit``.

    The weekly table has one row per week, so the ordered window is small."""
    w = Window.orderBy("week_start")
    out = weekly.withColumn("mae_breach", F.col("mae") > limit)
    run_ok = F.lit(True)
    for k in range(1, run):
        run_ok = run_ok & F.coalesce(F.lag("mae_breach", k).over(w), F.lit(False)) & \
            (F.lag("week_start", k).over(w) == F.col("week_start") - F.expr(f"INTERVAL {7 * k} DAYS"))
    return out.withColumn("alert", F.col("mae_breach") & run_ok)
