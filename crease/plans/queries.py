"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each one reads the supplied tables (through the delivery fixture) and runs the
library operator over the whole data. Output columns match ``oracle.SQL``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import deliveries as D
from crease.operators import features as FE
from crease.operators import playermatch as PMO
from crease.plans import base as B
from crease.plans.base import rnd
from crease.schema import BATTER_CLUSTER_FEATURES as BAT_F
from crease.schema import MODEL_FEATURES as MM_FEATURES
from crease.sources.deliveries import dirty_deliveries, fixture_deliveries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

POS = ["match_id", "innings", "over", "ball_in_over"]
PMK = ["match_id", "season", "team", "player"]


def q(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _csv_copy(spark, raw):
    """The rows as a CSV file with a leading index column, as some writers leave it."""
    from crease.sources.sinks import scratch_path
    path = scratch_path(spark, "deliveries-csv")
    raw.select(F.monotonically_increasing_id().alias("Unnamed: 0"), *raw.columns) \
        .write.mode("overwrite").option("header", "true").csv(path)
    return path


@q("scan_deliveries")
def _scan(spark, sf):
    from crease.sources.deliveries import scan_deliveries
    return scan_deliveries(spark, _csv_copy(spark, fixture_deliveries(spark, sf))).withColumns(
        {"match_date": F.col("match_date").cast("date"), "season": F.col("season").cast("int")})


@q("canonicalise_columns")
def _canon(spark, sf):
    return D.canonicalise_columns(fixture_deliveries(spark, sf))


@q("parse_date")
def _parse_date(spark, sf):
    return D.parse_date(D.canonicalise_columns(dirty_deliveries(spark, sf))).select(*POS, "date")


@q("numeric_coerce")
def _numeric(spark, sf):
    raw = D.canonicalise_columns(dirty_deliveries(spark, sf))
    return D.numeric_coerce(raw, ["runs_batter", "runs_total"]).select(*POS, "runs_batter", "runs_total")


@q("derive_over_ball")
def _over_ball(spark, sf):
    # Exercise the decimal path: replace over / ball_in_over by ``ball_no``
    # (0-based over + ball / 10), as in files that carry "6.1"-style positions.
    raw = fixture_deliveries(spark, sf)
    raw = raw.withColumn("ball_no", (F.col("over") - 1) + F.col("ball_in_over") / F.lit(10.0)) \
        .drop("over", "ball_in_over")
    return D.derive_over_ball(D.canonicalise_columns(raw)).select("match_id", "innings", "over", "ball_in_over")


@q("assign_phase")
def _phase(spark, sf):
    return B.deliveries(spark, sf).select(*POS, "phase")


#: Bins that overlap, as a user may give them: (name, first over, last over).
OVERLAPPING_BINS = [("New ball", 1, 3), ("Powerplay", 1, 6), ("Middle", 5, 15), ("Last over", 20, 20), ("Death", 15, 20)]


@q("phase_bins_table")
def _phase_bins(spark, sf):
    bins = spark.createDataFrame([(*b, i) for i, b in enumerate(OVERLAPPING_BINS)],
                                 "name string, first_over int, last_over int, position long")
    return D.assign_phase(B.deliveries(spark, sf).where("over <> 4"), bins).select(*POS, "phase")


@q("interval_join")
def _interval_join(spark, sf):
    """Orders' totals by the first of many overlapping bands, made of the parts' prices: the bucketed join."""
    from crease.operators.intervals import first_match
    from crease.sources.deliveries import read_table
    price = F.col("p_retailprice").cast("double")
    bands = read_table(spark, sf, "part").select((price * 50).alias("low"), (price * 60).alias("high"),
                                                 (F.col("p_partkey") % 2 == 0).alias("closed"),
                                                 F.col("p_partkey").alias("position"), F.col("p_partkey").alias("partkey"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return first_match(orders, "o_totalprice", bands, keep=("partkey",), broadcast_segments=0).select(
        "o_orderkey", "partkey")


@q("valid_ball_flag")
def _valid(spark, sf):
    return D.valid_ball_flag(D.canonicalise_columns(dirty_deliveries(spark, sf))).select(*POS, "valid_ball")


@q("dot_ball_flag")
def _dot(spark, sf):
    return B.deliveries(spark, sf).select(*POS, "is_dot_ball")


@q("wicket_flag")
def _wicket(spark, sf):
    return B.deliveries(spark, sf).select(*POS, "is_wicket")


@q("boundary_flags")
def _boundary(spark, sf):
    return B.deliveries(spark, sf).select(*POS, "is_boundary", "is_four", "is_six")


@q("batter_dismissed")
def _dismissed(spark, sf):
    return B.deliveries(spark, sf).select("match_id", "innings", "batter", "player_out", "batter_dismissed")


@q("bowler_wicket")
def _bowler_wicket(spark, sf):
    return B.deliveries(spark, sf).select("match_id", "innings", "bowler", "wicket_kind", "is_bowler_wicket")


@q("dq_checks")
def _dq(spark, sf):
    return D.dq_checks(B.deliveries(spark, sf))


@q("batting_player_match")
def _bat_pm(spark, sf):
    return PMO.batting_player_match(B.deliveries(spark, sf))


@q("bowling_player_match")
def _bowl_pm(spark, sf):
    return PMO.bowling_player_match(B.deliveries(spark, sf))


@q("phase_map_agg")
def _phase_maps(spark, sf):
    s = B.stats(spark, sf)
    parts = [PMO.phase_map_long(s, "phase_runs").withColumn("kind", F.lit("bowl_runs")),
             PMO.phase_map_long(s, "phase_balls").withColumn("kind", F.lit("bowl_balls")),
             PMO.phase_map_long(s, "phases").withColumn("kind", F.lit("bat_runs"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(*PMK, "kind", "phase", "value")


@q("bowler_phase_stats")
def _bps(spark, sf):
    return PMO.bowler_phase_stats(B.phase_long(spark, sf))


@q("league_phase_rate")
def _league(spark, sf):
    lg = PMO.league_phase_rate(PMO.bowler_phase_stats(B.phase_long(spark, sf)))
    return lg.select("phase", rnd("league_run_rate").alias("league_run_rate"))


@q("phase_efficacy")
def _eff(spark, sf):
    return B.stats(spark, sf).select(*PMK, rnd("phase_efficacy", 5).alias("phase_efficacy"))


@q("player_match_outer")
def _outer(spark, sf):
    return B.stats(spark, sf).select(*PMK, "_merge", "balls_faced", "balls_bowled")


@q("match_result")
def _result(spark, sf):
    return B.stats(spark, sf).select(*PMK, "winning_team", "team_won")


@q("batting_metrics")
def _bat_metrics(spark, sf):
    f = FE.batting_metrics(B.stats(spark, sf))
    return f.select(*PMK, *[rnd(c).alias(c) for c in
                            ["batting_strike_rate", "batting_average", "boundary_percentage", "dot_percentage"]],
                    "batting_contribution")


@q("bowling_metrics")
def _bowl_metrics(spark, sf):
    f = FE.bowling_metrics(B.stats(spark, sf))
    return f.select(*PMK, *[rnd(c).alias(c) for c in
                            ["overs_bowled", "bowling_economy", "bowling_strike_rate", "wickets_per_match"]])


@q("correlation_weights")
def _weights(spark, sf):
    f = B.features(spark, sf)
    return FE.weights_table(FE.correlation_weights(f)).select("metric", rnd("weight").alias("weight"))


@q("composite_indices")
def _indices(spark, sf):
    return B.indexed(spark, sf).select(*PMK, *[rnd(c, 4).alias(c) for c in
                                             ["batting_index", "bowling_index", "overall_index"]])


@q("model_matrix")
def _matrix(spark, sf):
    m = B.matrix(spark, sf)
    return m.select("match_id", "player", "team", "season", "team_won", *[rnd(c, 4).alias(c) for c in MM_FEATURES])


@q("feature_merge")
def _merge(spark, sf):
    f = B.features(spark, sf)
    keys = ["match_id", "season", "team", "player", "team_won", "winning_team"]
    bat = f.select(*keys, "balls_faced", "batting_strike_rate")
    bowl = f.select(*keys, "balls_faced", "bowling_economy")
    out = FE.feature_merge(bat, bowl, keys)
    return out.select(*keys, "balls_faced_bat", "balls_faced_bowl",
                      rnd("batting_strike_rate").alias("batting_strike_rate"),
                      rnd("bowling_economy").alias("bowling_economy"))


@q("impact_score")
def _impact(spark, sf):
    from crease.operators.ratings import impact_score
    s = impact_score(B.matrix(spark, sf), {c: 1.0 for c in MM_FEATURES})
    return s.select("match_id", "player", "team", "season", rnd("impact_score", 4).alias("impact_score"))


def _ratings(spark, sf):
    from crease.operators.ratings import player_ratings
    return player_ratings(B.matrix(spark, sf), {c: 1.0 for c in MM_FEATURES})


@q("player_ratings")
def _player_ratings(spark, sf):
    return _ratings(spark, sf).select("player", "team", "season", *[rnd(c, 4).alias(c) for c in
                                      ["impact_score", "batting_index", "bowling_index", "impact_rating"]])


@q("player_volume")
def _volume(spark, sf):
    from crease.operators.ratings import player_volume
    return player_volume(B.features(spark, sf))


@q("volume_outer")
def _volume_outer(spark, sf):
    from crease.operators.ratings import volume_outer
    f = B.features(spark, sf)
    return volume_outer(f.select("player", "team", "season", "balls_faced"),
                        f.select("player", "team", "season", "balls_bowled")) \
        .select("player", "team", "season", "balls_faced", "balls_bowled")


@q("top_ratings")
def _top(spark, sf):
    from crease.operators.ratings import top_ratings
    return top_ratings(_ratings(spark, sf)).select("player", "team", "season",
                                                   rnd("impact_rating", 4).alias("impact_rating"))


@q("attach_index")
def _attach(spark, sf):
    from crease.operators.ratings import attach_index
    f = B.features(spark, sf)
    idx = FE.composite_indices(f)
    bat = PMO.batting_player_match(B.deliveries(spark, sf))
    out = attach_index(FE.batting_metrics(bat), idx, "batting_index")
    return out.select(*PMK, "balls_faced", rnd("batting_strike_rate").alias("batting_strike_rate"),
                      rnd("batting_index", 4).alias("batting_index"))


@q("impact_tier")
def _tier(spark, sf):
    from crease.functions.expressions import impact_tier
    r = _ratings(spark, sf)
    return r.select("player", "team", "season", impact_tier("impact_rating", 1).alias("impact_tier"),
                    impact_tier("impact_rating", 2).alias("selection_priority"))


@q("safe_divide")
def _safe_div(spark, sf):
    from crease.functions.expressions import safe_divide
    s = B.stats(spark, sf)
    return s.select(*PMK, safe_divide("wickets", "balls_bowled").alias("wickets_per_ball"))


# ---------------------------------------------------------------- evaluation
def _sc(spark, sf):
    return B.scored(spark, sf)


def _one(df, col, digits=6):
    return df.select(rnd(col, digits).alias(col))


@q("metric_accuracy")
def _m_acc(spark, sf):
    from crease.operators.metrics import point_metrics
    return _one(point_metrics(_sc(spark, sf)), "accuracy")


@q("metric_f1")
def _m_f1(spark, sf):
    from crease.operators.metrics import point_metrics
    return _one(point_metrics(_sc(spark, sf)), "f1")


@q("metric_brier")
def _m_brier(spark, sf):
    from crease.operators.metrics import point_metrics
    return _one(point_metrics(_sc(spark, sf)), "brier_score")


@q("metric_log_loss")
def _m_ll(spark, sf):
    from crease.operators.metrics import point_metrics
    return _one(point_metrics(_sc(spark, sf)), "log_loss")


@q("metric_mae")
def _m_mae(spark, sf):
    from crease.operators.metrics import point_metrics
    return _one(point_metrics(_sc(spark, sf)), "mae")


@q("metric_roc_auc")
def _m_auc(spark, sf):
    from crease.operators.metrics import roc_auc
    return _one(roc_auc(_sc(spark, sf)), "roc_auc")


@q("metric_pr_auc")
def _m_ap(spark, sf):
    from crease.operators.metrics import pr_auc
    return _one(pr_auc(_sc(spark, sf)), "pr_auc")


@q("roc_points")
def _roc_pts(spark, sf):
    from crease.operators.metrics import roc_points
    return roc_points(_sc(spark, sf)).select(*[rnd(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@q("pr_points")
def _pr_pts(spark, sf):
    from crease.operators.metrics import pr_points
    return pr_points(_sc(spark, sf)).select(*[rnd(c).alias(c) for c in ("threshold", "precision", "recall")])


@q("classification_report")
def _report(spark, sf):
    from crease.operators.metrics import classification_report
    r = classification_report(_sc(spark, sf))
    return r.select("label", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@q("classify_threshold")
def _classify(spark, sf):
    from crease.functions.expressions import classify_threshold
    return _sc(spark, sf).select("rid", "y_pred_proba", classify_threshold("y_pred_proba").alias("y_pred"))


@q("matchup_key")
def _matchup(spark, sf):
    from crease.functions.expressions import matchup_key
    return _sc(spark, sf).select("rid", matchup_key("team", "opponent").alias("matchup"))


@q("season_int")
def _season_int(spark, sf):
    from crease.functions.expressions import season_int
    return dirty_deliveries(spark, sf).select("match_id", season_int("season").alias("season")).distinct()


@q("calibration_curve")
def _cal_curve(spark, sf):
    from crease.operators.calibration import calibration_bins
    s = _sc(spark, sf)
    parts = [calibration_bins(s, n_bins=10, strategy=st).withColumn("strategy", F.lit(st))
             for st in ("uniform", "quantile")]
    out = parts[0].unionByName(parts[1])
    return out.select("strategy", "bin", "n", rnd("fraction_of_positives").alias("fraction_of_positives"),
                      rnd("mean_predicted_value").alias("mean_predicted_value"))


@q("expected_calibration_error")
def _ece(spark, sf):
    from crease.operators.calibration import expected_calibration_error
    return _one(expected_calibration_error(_sc(spark, sf)), "ece")


@q("probability_histogram")
def _hist(spark, sf):
    from crease.operators.calibration import probability_histogram
    h = probability_histogram(_sc(spark, sf))
    return h.select("bin", rnd("bin_start").alias("bin_start"), "count", rnd("density").alias("density"))


def _slice_out(df, key):
    return df.select(key, "n_samples", *[rnd(c).alias(c) for c in
                                         ("accuracy", "roc_auc", "log_loss", "positive_rate")])


@q("slice_metrics")
def _slices(spark, sf):
    from crease.operators.slices import slice_metrics
    return _slice_out(slice_metrics(_sc(spark, sf), "team", min_samples=10), "team")


@q("slice_by_season")
def _by_season(spark, sf):
    from crease.operators.slices import slice_by_season
    return _slice_out(slice_by_season(_sc(spark, sf)), "season")


@q("slice_by_venue")
def _by_venue(spark, sf):
    from crease.operators.slices import slice_by_venue
    return _slice_out(slice_by_venue(_sc(spark, sf)), "venue")


@q("slice_by_matchup")
def _by_matchup(spark, sf):
    from crease.operators.slices import slice_by_matchup
    return _slice_out(slice_by_matchup(_sc(spark, sf), "team", "opponent"), "matchup")


@q("drift_first_last")
def _drift_fl(spark, sf):
    from crease.operators.slices import drift_first_last, slice_by_season
    sm = _slice_out(slice_by_season(_sc(spark, sf)), "season")
    d = drift_first_last(sm)
    return d.select("metric", "first_season", "last_season", *[rnd(c).alias(c) for c in
                    ("first_value", "last_value", "change")], rnd("change_pct", 4).alias("change_pct"),
                    rnd("mean_value").alias("mean_value"), "trend")


@q("drift_report")
def _drift(spark, sf):
    from crease.operators.slices import drift_report, slice_by_season
    sm = _slice_out(slice_by_season(_sc(spark, sf)), "season")
    return drift_report(sm).select("kind", "season", "metric", rnd("value").alias("value"), "trend")


def _fail_out(df):
    return df.select("match_id", "player", "team", "season", "y_true", "y_pred_proba", rnd("error").alias("error"),
                     "failure_type")


@q("top_failures")
def _top_fail(spark, sf):
    from crease.operators.slices import top_failures
    return _fail_out(top_failures(_sc(spark, sf), n_top=5))


@q("failure_union")
def _fail_union(spark, sf):
    from crease.operators.slices import top_failures
    return _fail_out(top_failures(_sc(spark, sf), n_top=8))


@q("failure_report")
def _fail_report(spark, sf):
    from crease.operators.slices import failure_report, top_failures
    return failure_report(top_failures(_sc(spark, sf), n_top=8))


@q("write_failures_csv")
def _write_fail(spark, sf):
    from crease.operators.slices import top_failures
    from crease.sources.sinks import read_csv_back, write_failures_csv
    path = write_failures_csv(_fail_out(top_failures(_sc(spark, sf), n_top=8)), None)
    return read_csv_back(spark, path, "match_id bigint, player string, team string, season int, y_true int, "
                         "y_pred_proba double, error double, failure_type string")


@q("write_slice_csv")
def _write_slice(spark, sf):
    from crease.operators.slices import slice_by_season
    from crease.sources.sinks import read_csv_back, write_slice_csv
    path = write_slice_csv(_slice_out(slice_by_season(_sc(spark, sf)), "season"), None)
    return read_csv_back(spark, path, "season int, n_samples bigint, accuracy double, roc_auc double, "
                         "log_loss double, positive_rate double")


@q("precision_at_k_upsets")
def _p_at_k(spark, sf):
    from crease.operators.metrics import precision_at_k_upsets
    return precision_at_k_upsets(_sc(spark, sf), k=20).select(rnd("precision_at_k").alias("precision_at_k"),
                                                             "k_rows")


@q("policy_band_join")
def _bands(spark, sf):
    from crease.operators.policy import policy_band_join
    return policy_band_join(_sc(spark, sf).select("rid", "y_pred_proba"))


@q("kpi_alerts")
def _alerts(spark, sf):
    from crease.operators.calibration import expected_calibration_error
    from crease.operators.metrics import point_metrics, precision_at_k_upsets, roc_auc
    from crease.operators.policy import kpi_alerts
    s = _sc(spark, sf)
    m = expected_calibration_error(s).select(F.lit("expected_calibration_error").alias("metric"),
                                             F.col("ece").alias("value")) \
        .unionByName(roc_auc(s).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))) \
        .unionByName(point_metrics(s).select(F.lit("mean_absolute_error").alias("metric"),
                                             F.col("mae").alias("value"))) \
        .unionByName(precision_at_k_upsets(s, k=20).select(F.lit("precision_at_20").alias("metric"),
                                                           F.col("precision_at_k").alias("value")))
    return kpi_alerts(m).select("metric", rnd("value").alias("value"), "threshold", "direction", "breached", "action")


# ------------------------------------------------------------------ splits
@q("time_split")
def _time_split(spark, sf):
    from crease.operators.splits import time_split
    return time_split(_sc(spark, sf)).select("rid", "season", "split")


@q("split_summary")
def _split_summary(spark, sf):
    from crease.operators.splits import split_summary, time_split
    s = split_summary(time_split(_sc(spark, sf)), target="y_true")
    return s.select("split", "n_samples", "n_unique_matches", "seasons", rnd("win_rate").alias("win_rate"),
                    "n_wins", "n_losses")


@q("distinct_match_splits")
def _dms(spark, sf):
    from crease.operators.splits import distinct_match_splits, time_split
    return distinct_match_splits(time_split(_sc(spark, sf)))


@q("write_split_manifest")
def _manifest(spark, sf):
    from crease.operators.splits import time_split, write_split_manifest
    from crease.sources.sinks import read_csv_back
    path, _ = write_split_manifest(time_split(_sc(spark, sf)), target="y_true")
    return read_csv_back(spark, path, "match_id bigint, split string")


@q("rolling_origin_cv")
def _rolling(spark, sf):
    from crease.operators.splits import rolling_origin_summary
    out = rolling_origin_summary(_sc(spark, sf), "y_true", 3)
    return out.select("fold", "test_season", "role", "n_samples", "seasons", rnd("win_rate").alias("win_rate"))


@q("stratified_split")
def _strat(spark, sf):
    from crease.operators.splits import stratified_split
    return stratified_split(_sc(spark, sf), "y_true", "rid", 0.2, 42).select("rid", "y_true", "split")


# --------------------------------------------------------------- bootstrap
def _ci_out(df):
    return df.select("metric", *[rnd(c).alias(c) for c in ("value", "ci_lower", "ci_upper")])


@q("bootstrap_ci")
def _boot(spark, sf):
    from crease.operators.bootstrap import bootstrap_metrics
    return _ci_out(bootstrap_metrics(_sc(spark, sf), metrics=["accuracy"], n_boot=1000, seed=42))


def _mci(spark, sf):
    from crease.operators.bootstrap import bootstrap_metrics
    return bootstrap_metrics(_sc(spark, sf), n_boot=1000, seed=42)


@q("metrics_with_ci")
def _metrics_ci(spark, sf):
    return _ci_out(_mci(spark, sf))


@q("format_metric_ci")
def _fmt_ci(spark, sf):
    from crease.functions.expressions import format_metric_ci
    return _mci(spark, sf).select("metric", format_metric_ci("value", "ci_lower", "ci_upper").alias("formatted"))


@q("paired_bootstrap_delta")
def _paired(spark, sf):
    from crease.operators.bootstrap import paired_bootstrap_delta
    s = _sc(spark, sf)
    vp = s.groupBy("venue").agg(F.avg(F.col("y_true").cast("double")).alias("p_base"))
    d = s.join(vp, "venue", "inner")
    out = paired_bootstrap_delta(d, "y_true", "y_pred_proba", "p_base", "roc_auc", 1000, 0.95, 42)
    return out.select("metric", *[rnd(c).alias(c) for c in ("delta", "ci_lower", "ci_upper")])


# --------------------------------------------------------------- baselines
def _split(spark, sf):
    from crease.operators.splits import time_split
    return time_split(_sc(spark, sf), check=False)


def _train_test(spark, sf):
    d = _split(spark, sf)
    return d.filter(F.col("split") == "train").drop("split"), d.filter(F.col("split") == "test").drop("split")


@q("venue_baseline")
def _venue(spark, sf):
    from crease.operators.baselines import venue_baseline
    trn, _ = _train_test(spark, sf)
    return venue_baseline(trn).table.select("venue", rnd("prior").alias("prior"), "n")


@q("venue_prior_lookup")
def _venue_lookup(spark, sf):
    from crease.operators.baselines import venue_baseline, venue_prior_lookup
    trn, tst = _train_test(spark, sf)
    return venue_prior_lookup(tst, venue_baseline(trn)).select("rid", "venue", rnd("p_baseline").alias("p_baseline"))


@q("evaluate_baseline")
def _eval_base(spark, sf):
    from crease.operators.baselines import evaluate_baseline, venue_baseline
    trn, tst = _train_test(spark, sf)
    e = evaluate_baseline(venue_baseline(trn).predict(tst))
    return e.select(*[rnd(c).alias(c) for c in ("accuracy", "roc_auc", "log_loss")],
                    F.col("n_samples").cast("long").alias("n_samples"))


@q("recent_form")
def _form(spark, sf):
    from crease.operators.baselines import recent_form
    trn, _ = _train_test(spark, sf)
    return recent_form(trn, window=5).select("team", rnd("prior").alias("prior"), "n")


@q("recent_form_baseline")
def _form_base(spark, sf):
    from crease.operators.baselines import recent_form_baseline
    trn, tst = _train_test(spark, sf)
    return recent_form_baseline(trn, window=5).predict(tst).select("rid", "team", rnd("p_baseline").alias("p_baseline"))


@q("logistic_baseline")
def _logit(spark, sf):
    """The fit, held against its own optimality: the gradient of the penalised loss is 0 at the coefficients."""
    from crease.operators.baselines import logistic_baseline, logistic_gradient
    from crease.operators.splits import time_split
    train = time_split(B.matrix(spark, sf), check=False).filter(F.col("split") == "train")
    g = logistic_gradient(train, logistic_baseline(train, "team_won"), "team_won")
    return g.select("coefficient", (F.abs("gradient") < 1e-3).alias("optimal"))


@q("logistic_score")
def _logit_score(spark, sf):
    from crease.operators.baselines import LOGISTIC_FEATURES, LinearScorer, logistic_score
    scorer = LinearScorer(LOGISTIC_FEATURES, [0.01, -0.02, 0.05, -0.03, 0.04, 0.02], -0.25)
    return logistic_score(B.matrix(spark, sf), scorer).select("match_id", "team", "player",
                                                              rnd("p_baseline").alias("p_baseline"))


# ------------------------------------------------------------------ roles
@q("standardise")
def _standardise(spark, sf):
    from crease.operators.roles import standardise
    z, _, _ = standardise(B.indexed(spark, sf), BAT_F)
    return z.select("rid", *[rnd(c + "_z").alias(c + "_z") for c in BAT_F])


@q("kmeans_assign")
def _kassign(spark, sf):
    return B.clusters(spark, sf)[0].assigned.select("rid", "batter_cluster")


@q("cluster_batters")
def _cbat(spark, sf):
    return B.clusters(spark, sf)[0].assigned.select("rid", "player", "batter_cluster")


@q("cluster_bowlers")
def _cbowl(spark, sf):
    return B.clusters(spark, sf)[1].assigned.select("rid", "player", "bowler_cluster")


@q("label_batter_clusters")
def _lbat(spark, sf):
    return B.clusters(spark, sf)[2]


@q("label_bowler_clusters")
def _lbowl(spark, sf):
    return B.clusters(spark, sf)[3]


@q("cluster_mode")
def _cmode(spark, sf):
    from crease.operators.roles import cluster_mode
    bat, bowl, _, _ = B.clusters(spark, sf)
    return cluster_mode(bat.assigned, "batter_cluster").join(cluster_mode(bowl.assigned, "bowler_cluster"), "player")


@q("role_label_map")
def _rlm(spark, sf):
    from crease.operators.roles import role_label_map
    bat, _, bl, _ = B.clusters(spark, sf)
    return role_label_map(bat.assigned, bl, "batter_cluster", "batter_role").select("rid", "batter_cluster",
                                                                                   "batter_role")


@q("cluster_centroid_points")
def _ccp(spark, sf):
    from crease.operators.roles import cluster_centroid_points, role_label_map
    bat, _, bl, _ = B.clusters(spark, sf)
    a = role_label_map(bat.assigned, bl, "batter_cluster", "batter_role")
    c = cluster_centroid_points(a, "batting_strike_rate", "boundary_percentage", "batter_role")
    return c.select("batter_role", rnd("batting_strike_rate", 4).alias("batting_strike_rate"),
                    rnd("boundary_percentage", 4).alias("boundary_percentage"))


@q("kmeans_fit")
def _kfit(spark, sf):
    """The fit with restarts, held against what a k-means fixed point is."""
    from crease.operators.roles import kmeans_check, kmeans_fit
    r = kmeans_fit(B.indexed(spark, sf), BAT_F, k=4, restarts=20, seed=42, out="batter_cluster")
    return kmeans_check(r, "batter_cluster").select("cluster", "misassigned", rnd("drift").alias("drift"))


@q("primary_role")
def _prole(spark, sf):
    return B.profiles(spark, sf).select("player", "team", "season", "primary_role")


@q("player_profiles")
def _profiles(spark, sf):
    return B.profiles(spark, sf).select("player", "team", "season", rnd("impact_rating", 4).alias("impact_rating"),
                                        "balls_faced", "balls_bowled", "batter_cluster", "bowler_cluster",
                                        "batter_role", "bowler_role", "primary_role")


@q("best_xi")
def _xi(spark, sf):
    from crease.operators.team import best_xi
    x = best_xi(B.profiles(spark, sf))
    return x.select("player", "team", "season", rnd("impact_rating", 4).alias("impact_rating"), "primary_role",
                    "rank_in_xi")


@q("player_explorer_filter")
def _explorer(spark, sf):
    from crease.operators.team import player_explorer_filter
    p = player_explorer_filter(B.profiles(spark, sf))
    return p.select("player", "team", "season", rnd("impact_rating", 4).alias("impact_rating"), "primary_role",
                    "balls_faced", "balls_bowled")


# ------------------------------------------------------------- misc / model
@q("drop_unnamed")
def _drop_unnamed(spark, sf):
    """Round trip through CSV with an index column, which is dropped; types are given."""
    from crease.sources.deliveries import scan_deliveries
    raw = fixture_deliveries(spark, sf)
    schema = "`Unnamed: 0` bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return scan_deliveries(spark, _csv_copy(spark, raw), "csv", schema=schema)


@q("export_summary_json")
def _export(spark, sf):
    from crease.operators.metrics import binary_metrics
    from crease.sources.sinks import export_summary
    m = binary_metrics(_sc(spark, sf)).select("accuracy", "roc_auc").first()
    _, _, bl, wl = B.clusters(spark, sf)
    path = export_summary(m.asDict(), bl, wl)
    return spark.read.schema("section string, key string, value string").json(path)


@q("importance_summary")
def _importance(spark, sf):
    from crease.operators.explain import importance_summary
    imp = importance_summary(B.matrix(spark, sf), MM_FEATURES)
    return imp.select("feature", rnd("mean_abs_shap").alias("mean_abs_shap"))


@q("prior_match_metrics")
def _prior(spark, sf):
    s = B.features(spark, sf).join(B.match_info(spark, sf).select("match_id", "date"), "match_id", "inner")
    p = FE.prior_match_metrics(s.select("match_id", "season", "team", "player", "date", "runs_scored", "balls_faced",
                                        "dismissals", "wickets", "balls_bowled", "runs_conceded"))
    return p.select("match_id", "season", "team", "player", F.col("prior_matches").cast("long").alias("prior_matches"),
                    rnd("prior_runs").alias("prior_runs"),
                    *[F.col(c).cast("double").alias(c) for c in ("prior_balls_faced", "prior_wickets",
                                                                 "prior_balls_bowled")],
                    *[rnd(c).alias(c) for c in ("prior_strike_rate", "prior_batting_average", "prior_economy")])


@q("weekly_kpi_breach")
def _weekly(spark, sf):
    from crease.operators.policy import weekly_kpi, weekly_kpi_breach
    from crease.sources.deliveries import read_table
    from crease.streaming.weekly import events_to_scored
    wk = weekly_kpi_breach(weekly_kpi(events_to_scored(read_table(spark, sf, "events"))))
    return wk.select("week_start", F.col("n").cast("long").alias("n"), rnd("mae").alias("mae"), rnd("ece").alias("ece"),
                     "mae_breach", "alert")


@q("platt_apply")
def _platt_apply(spark, sf):
    from crease.operators.calibration import PlattCalibrator, platt_apply
    out = platt_apply(_sc(spark, sf), PlattCalibrator(4.0, -2.0))
    return out.select("rid", rnd("y_pred_calibrated").alias("y_pred_calibrated"))


def _val_test(spark, sf):
    d = _split(spark, sf)
    return d.filter(F.col("split") == "val").drop("split"), d.filter(F.col("split") == "test").drop("split")


@q("platt_fit")
def _platt_fit(spark, sf):
    """The fit, held against its own optimality: the gradient of the penalised loss is 0 at the coefficients."""
    from crease.operators.calibration import platt_fit, platt_gradient
    val, _ = _val_test(spark, sf)
    return platt_gradient(val, platt_fit(val)).select("coefficient", rnd("gradient", 5).alias("gradient"))


@q("isotonic_fit")
def _iso_fit(spark, sf):
    from crease.operators.calibration import isotonic_apply, isotonic_fit
    val, _ = _val_test(spark, sf)
    scores = val.select("y_pred_proba").distinct()
    return isotonic_apply(scores, isotonic_fit(val)).select("y_pred_proba", rnd("y_pred_calibrated").alias("fitted"))


@q("isotonic_apply")
def _iso_apply(spark, sf):
    from crease.operators.calibration import isotonic_apply, isotonic_fit
    val, tst = _val_test(spark, sf)
    return isotonic_apply(tst, isotonic_fit(val)).select("rid", "y_pred_proba",
                                                         rnd("y_pred_calibrated").alias("y_pred_calibrated"))


@q("calibrate_model")
def _calibrate(spark, sf):
    from crease.operators.calibration import calibrate_model
    val, tst = _val_test(spark, sf)
    return calibrate_model(val, tst, method="isotonic").select("rid", "y_true", "y_pred_proba",
                                                               rnd("y_pred_calibrated").alias("y_pred_calibrated"))


def _trained(spark, sf):
    from crease.operators.model import train_impact_model
    key = (spark.sparkContext.applicationId, sf, "trained")
    if key not in B._MEMO:
        B._MEMO[key] = train_impact_model(B.matrix(spark, sf), MM_FEATURES)
    return B._MEMO[key]


@q("train_impact_model")
def _train(spark, sf):
    """The rows the model was tested on, and whether each has a probability and the prediction that follows from it."""
    p = F.col("y_pred_proba")
    sound = F.coalesce(p.between(0, 1) & (F.col("y_pred") == (p >= 0.5).cast("int")), F.lit(False))
    return _trained(spark, sf).test.select("rid", F.col("team_won").cast("int").alias("team_won"), sound.alias("sound"))


def _reloaded(spark, sf):
    """Scores of the test rows by the trained model and by its saved copy, and the copy's metadata."""
    from crease.operators.model import load_model, save_model, score
    from crease.sources.sinks import scratch_path
    art = _trained(spark, sf)
    base = scratch_path(spark, "models")
    save_model(art, f"{base}/best_model")
    model, meta = load_model(spark, base)
    again = score(model, art.test.drop("y_pred_proba", "y_pred")).select("rid", F.col("y_pred_proba").alias("p_again"))
    return art.test.join(again, "rid", "left"), meta


@q("save_model")
def _save(spark, sf):
    """Per feature of the saved metadata: the rows scored by the saved model, and how many scores differ."""
    both, meta = _reloaded(spark, sf)
    sums = both.agg(F.count(F.lit(1)).alias("n_scored"),
                    F.count_if(~F.col("p_again").eqNullSafe(F.col("y_pred_proba"))).alias("mismatches"))
    names = F.array(*[F.lit(c) for c in meta.get("feature_columns", [])])
    return sums.select(F.explode(names).alias("feature"), "n_scored", "mismatches")


@q("load_model")
def _load(spark, sf):
    both, _ = _reloaded(spark, sf)
    return both.select("rid", F.col("p_again").eqNullSafe(F.col("y_pred_proba")).alias("same_score"))


@q("shap_values")
def _shap(spark, sf):
    """Every training row: whether its contributions and the base value add up to the model's own margin."""
    from crease.operators.boosting import with_margins
    from crease.operators.explain import shap_values
    a = _trained(spark, sf)
    values = shap_values(a.train, a.model, MM_FEATURES, keep=["rid"])
    margin = with_margins(a.train, a.model, "raw").select("rid", "raw")
    total = F.col("base_value")
    for c in MM_FEATURES:
        total = total + F.col(c)
    return values.withColumn("total", total).join(margin, "rid").select(
        "rid", (F.abs(F.col("total") - F.col("raw")) < 1e-6).alias("additive"))


#: Features with few values, each of which is a cut.
COUNT_FEATURES = ["boundaries", "dismissals", "wickets"]


@q("boosting_first_split")
def _first_split(spark, sf):
    """The root of the first tree over all rows: the split that gains most, and its leaves."""
    from crease.operators.boosting import BoostingParams, fit_boosted_trees
    one = BoostingParams(rounds=1, max_depth=1, subsample=1.0, colsample=1.0)
    model = fit_boosted_trees(B.features(spark, sf), COUNT_FEATURES, "team_won", params=one)
    nodes = model.nodes(spark)
    root, leaf = nodes.where("node = 0"), nodes.where("node > 0")
    values = leaf.agg(F.min_by("value", "node").alias("left_value"), F.max_by("value", "node").alias("right_value"))
    names = F.array(*[F.lit(c) for c in COUNT_FEATURES])
    return root.select(names[F.col("feature")].alias("feature"), "cut", rnd("gain", 2).alias("gain"),
                       rnd("cover", 2).alias("cover")).join(F.broadcast(values)).select(
        "feature", "cut", "gain", "cover", rnd("left_value").alias("left_value"), rnd("right_value").alias("right_value"))
