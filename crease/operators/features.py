"""Rate metrics, correlation weights, composite indices and the model matrix."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.expressions import known, safe_divide, zero
from crease.schema import (
    BATTING_METRICS, BOWLING_METRICS, METRIC_COLUMNS, MODEL_FEATURES, OPTIONAL_RAW_FEATURES,
)

ID_COLUMNS = ["match_id", "player", "team", "season", "team_won", "rid"]


def batting_metrics(stats: DataFrame) -> DataFrame:
    """Strike rate, average (no dismissal -> 0), boundary %, dot %, contribution."""
    return stats.withColumns({
        "batting_strike_rate": safe_divide(zero("runs_scored") * 100, zero("balls_faced")),
        "batting_average": safe_divide(zero("runs_scored"), zero("dismissals")),
        "boundary_percentage": safe_divide(zero("boundaries") * 100, zero("balls_faced")),
        "dot_percentage": safe_divide(zero("dot_balls") * 100, zero("balls_faced")),
        "batting_contribution": zero("runs_scored"),
    })


def bowling_metrics(stats: DataFrame) -> DataFrame:
    """Overs, economy, strike rate, wickets per match (efficacy comes from the aggregate)."""
    overs = zero("balls_bowled") / F.lit(6.0)
    out = stats.withColumns({
        "overs_bowled": overs,
        "bowling_economy": safe_divide(zero("runs_conceded"), overs),
        "bowling_strike_rate": safe_divide(zero("balls_bowled"), zero("wickets")),
        "wickets_per_match": zero("wickets"),
    })
    if "phase_efficacy" not in out.columns:
        out = out.withColumn("phase_efficacy", F.lit(0.0))
    return out


def feature_frame(stats: DataFrame) -> DataFrame:
    """Batting and bowling metrics side by side, numeric nulls -> 0.

    The reference merges two frames derived from the same rows; here both
    come from the same rows, so it is one projection and no join.
    """
    out = bowling_metrics(batting_metrics(stats))
    numeric = [c for c, t in out.dtypes if t in ("double", "bigint", "int", "float", "smallint")
               and c not in ("match_id", "season")]
    return out.fillna(0, subset=numeric).replace(float("nan"), 0.0, subset=[c for c in numeric
                                                                            if dict(out.dtypes)[c] in ("double", "float")])


def feature_merge(batting: DataFrame, bowling: DataFrame,
                  keys: Sequence[str] = ("match_id", "season", "team", "player", "team_won", "winning_team"),
                  suffixes: tuple[str, str] = ("_bat", "_bowl")) -> DataFrame:
    """Generic outer merge of two feature frames; null keys match (``eqNullSafe``)
    and overlapping non-key columns get suffixes."""
    keys = list(keys)
    overlap = (set(batting.columns) & set(bowling.columns)) - set(keys)
    left = batting.select(*[F.col(c).alias(c + suffixes[0] if c in overlap else c) for c in batting.columns])
    right = bowling.select(*[F.col(c).alias("_r_" + c if c in keys else (c + suffixes[1] if c in overlap else c))
                             for c in bowling.columns])
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(right["_r_" + k])
        cond = term if cond is None else cond & term
    joined = left.join(right, cond, "full_outer")
    joined = joined.withColumns({k: F.coalesce(F.col(k), F.col("_r_" + k)) for k in keys})
    return joined.drop(*["_r_" + k for k in keys])


def correlation_weights(features: DataFrame, metrics: Sequence[str] = METRIC_COLUMNS,
                        target: str = "team_won", method: str = "correlation") -> DataFrame:
    """One-row frame with a ``weights`` array: |Pearson(metric, target)| per metric,
    zero variance or NaN -> 0, normalised to sum 1; all zero -> uniform.

    One aggregate (map-side partial) over the whole table.
    """
    n = len(metrics)
    if method != "correlation" or target not in features.columns:
        return features.sparkSession.range(1).select(
            F.array(*[F.lit(1.0 / n)] * n).alias("weights"))
    t = F.col(target).cast("double")
    raw = []
    for m in metrics:
        x = known(m)
        # corr() divides by zero on a constant column under ANSI: guard explicitly
        den = F.stddev_pop(x) * F.stddev_pop(t)
        c = F.when(den > 0, F.covar_pop(x, t) / den)
        raw.append(F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.abs(c)))
    agg = features.agg(F.array(*raw).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)
    return agg.select(F.when(total == 0, F.array(*[F.lit(1.0 / n)] * n))
                      .otherwise(F.transform("w", lambda x: x / total)).alias("weights"))


def weights_table(weights: DataFrame, metrics: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """``(metric, weight)`` rows from the one-row weights frame."""
    names = F.array(*[F.lit(m) for m in metrics])
    return weights.select(F.explode(F.arrays_zip(names.alias("metric"), F.col("weights").alias("weight")))
                          .alias("z")).select("z.metric", "z.weight")


def composite_indices(features: DataFrame, weights: DataFrame | None = None,
                      target: str = "team_won", method: str = "correlation") -> DataFrame:
    """batting_index, bowling_index (weighted row sums) and overall_index; a metric
    that is absent counts as 0.

    The weights are a scalar subquery: computed once, no join, plan stays lazy.
    """
    features = features.withColumns({m: F.lit(0.0) for m in METRIC_COLUMNS if m not in features.columns})
    if weights is None:
        weights = correlation_weights(features, METRIC_COLUMNS, target, method)
    w = weights.select("weights").scalar()
    bat = None
    for i, m in enumerate(BATTING_METRICS):
        term = zero(m) * w[i]
        bat = term if bat is None else bat + term
    bowl = None
    for i, m in enumerate(BOWLING_METRICS):
        term = zero(m) * w[len(BATTING_METRICS) + i]
        bowl = term if bowl is None else bowl + term
    return features.withColumns({"batting_index": bat, "bowling_index": bowl}) \
        .withColumn("overall_index", F.col("batting_index") + F.col("bowling_index"))


def model_matrix(features: DataFrame, feature_cols: Sequence[str] = MODEL_FEATURES,
                 include_raw: bool = False) -> tuple[DataFrame, list[str]]:
    """Identifiers, target and available features, nulls -> 0.

    Default: the 12 features of the reference's saved model (quirk Q8);
    ``include_raw`` adds runs_scored, balls_faced and wickets.
    """
    wanted = list(feature_cols) + (OPTIONAL_RAW_FEATURES if include_raw else [])
    cols = [c for c in wanted if c in features.columns]
    ids = [c for c in ID_COLUMNS if c in features.columns]
    out = features.select(*ids, *[zero(c).alias(c) for c in cols])
    return out, cols


def prior_match_metrics(stats: DataFrame, order_cols: Sequence[str] = ("date", "match_id"),
                        key: str = "player") -> DataFrame:
    """Leak-safe features: each player's totals over PREVIOUS matches only.

    Running sums use prefix sums partitioned by player (``ordered.prefix_sums``),
    so a player with a huge history is spread over many tasks instead of one
    window task. Matches are ordered by date, then by match id of any size; a
    null player is a group of its own, and undated matches come first."""
    from crease.operators.ordered import prefix_sums
    date_c, match_c = order_cols
    d = stats.withColumn("_day", F.coalesce(F.unix_date(F.col(date_c)).cast("long"),
                                            F.lit(-10_000_000).cast("long")))
    sums = {"_one": F.lit(1).cast("long"), "_runs": zero("runs_scored"), "_bf": zero("balls_faced"),
            "_dis": zero("dismissals"), "_wk": zero("wickets"), "_bb": zero("balls_bowled"),
            "_rc": zero("runs_conceded")}
    d = d.withColumns(sums)
    c = prefix_sums(d, "_day", list(sums), [key], inclusive=False, then=[match_c],
                    bounds=F.array(*[d.agg(f(F.when(F.col(date_c).isNotNull(), F.col("_day"))).cast("double")).scalar()
                                     for f in (F.min, F.max)]))
    return c.select(*[x for x in stats.columns], F.col("cum__one").alias("prior_matches"),
                    F.col("cum__runs").alias("prior_runs"), F.col("cum__bf").alias("prior_balls_faced"),
                    F.col("cum__wk").alias("prior_wickets"), F.col("cum__bb").alias("prior_balls_bowled"),
                    safe_divide(F.col("cum__runs") * 100, F.col("cum__bf")).alias("prior_strike_rate"),
                    safe_divide(F.col("cum__runs"), F.col("cum__dis")).alias("prior_batting_average"),
                    safe_divide(F.col("cum__rc"), F.col("cum__bb") / 6.0).alias("prior_economy"))
