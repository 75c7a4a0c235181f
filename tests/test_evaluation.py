import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.operators import metrics as M
from crease.operators.bootstrap import bootstrap_metrics
from crease.operators.calibration import (
    calibration_curve, expected_calibration_error, fit_calibrator, apply_calibrator, calibrate_model,
)
from crease.operators.ordered import exact_quantiles, prefix_sums


def _frame(spark, y, p):
    rows = [(i, int(a), float(b), int(b >= 0.5)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "rid long, y_true int, y_pred_proba double, y_pred int")


def _auc_brute(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _ap_brute(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_rank_metrics_match_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 300).tolist()
    p = np.round(rng.random(300), 2).tolist()  # many ties
    df = _frame(spark, y, p)
    assert M.roc_auc(df).first()[0] == pytest.approx(_auc_brute(y, p))
    assert M.pr_auc(df).first()[0] == pytest.approx(_ap_brute(y, p))


def test_single_class_gives_null_auc(spark):
    df = _frame(spark, [1, 1, 1], [0.2, 0.5, 0.9])
    assert M.roc_auc(df).first()[0] is None


def test_point_metrics_by_hand(spark):
    # 7 rows: 3 true positives, 1 false positive, 1 false negative, 2 true negatives
    df = _frame(spark, [1, 1, 1, 0, 1, 0, 0], [0.91, 0.72, 0.55, 0.64, 0.31, 0.12, 0.45])
    r = M.point_metrics(df).first()
    assert r.accuracy == pytest.approx(5 / 7) and r.f1 == pytest.approx(6 / 8)
    assert r.mae == pytest.approx((0.09 + 0.28 + 0.45 + 0.64 + 0.69 + 0.12 + 0.45) / 7)


def test_prefix_sums_and_quantiles(spark):
    rng = np.random.default_rng(3)
    v = rng.random(500)
    df = spark.createDataFrame([(float(x), 1) for x in v], "x double, one long")
    cum = {r.x: r.cum_one for r in prefix_sums(df, "x", ["one"]).collect()}
    xs = sorted(v)
    assert all(cum[x] == i + 1 for i, x in enumerate(xs))
    q = {r.q: r.value for r in exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.975, 1.0]).collect()}
    for k, val in q.items():
        assert val == pytest.approx(np.percentile(v, k * 100))


def _noisy(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return y.tolist(), np.round(np.clip(0.5 + 0.25 * (2 * y - 1) + rng.normal(0, 0.3, n), 0.01, 0.99), 2).tolist()


def test_bootstrap_deterministic_and_ordered(spark):
    df = _frame(spark, *_noisy(150, 11))
    a = {r.metric: r for r in bootstrap_metrics(df, n_boot=50).collect()}
    b = {r.metric: r for r in bootstrap_metrics(df.repartition(3), n_boot=50).collect()}
    for m, r in a.items():
        assert (r.value, r.ci_lower, r.ci_upper) == pytest.approx((b[m].value, b[m].ci_lower, b[m].ci_upper))
        assert r.ci_lower <= r.value <= r.ci_upper


def test_bootstrap_without_errors_has_no_width(spark):
    y = [0, 0, 1, 1, 1] * 9
    r = bootstrap_metrics(_frame(spark, y, [0.04 if v == 0 else 0.97 for v in y]), metrics=["accuracy"], n_boot=30).first()
    assert (r.value, r.ci_lower, r.ci_upper) == (1.0, 1.0, 1.0)


def test_bootstrap_interval_is_that_of_resampled_rows(spark):
    y, p = _noisy(400, 5)
    r = bootstrap_metrics(_frame(spark, y, p), metrics=["accuracy"], n_boot=600).first()
    hits = (np.array(y) == (np.array(p) >= 0.5)).astype(float)
    rng = np.random.default_rng(1)
    means = [hits[rng.integers(0, 400, 400)].mean() for _ in range(2000)]
    assert r.ci_lower == pytest.approx(np.percentile(means, 2.5), abs=0.012)
    assert r.ci_upper == pytest.approx(np.percentile(means, 97.5), abs=0.012)


def test_poisson_weights_of_groups_have_mean_and_variance_of_their_rows(spark):
    from crease.operators.bootstrap import replicate_weights, score_counts
    rows = [(i, i % 2, 0.25 if i < 300 else 0.75 if i < 306 else 0.5, 1) for i in range(330)]
    df = spark.createDataFrame(rows, "rid long, y int, p double, h int")
    w = replicate_weights(score_counts(df, "y", {"m": "h"}, {"m": "p"}), 3000).groupBy("_p_m", "_y", "replicate").agg(
        F.sum("w").alias("w")).groupBy("_p_m", "_y").agg(F.avg("w").alias("mean"), F.variance("w").alias("var")).collect()
    for r in w:
        n = {0.25: 150, 0.75: 3, 0.5: 12}[r._p_m]
        assert r["mean"] == pytest.approx(n, rel=0.05) and r["var"] == pytest.approx(n, rel=0.15)


def test_own_metric_in_bootstrap_and_paired_delta(spark):
    from crease.operators.bootstrap import paired_bootstrap_delta
    y, p = _noisy(200, 3)
    df = _frame(spark, y, p).withColumn("half", F.lit(0.5))

    def closeness(w, yv, h, s):
        return 1 - F.sum(w * F.abs(yv - s)) / F.sum(w)

    r = bootstrap_metrics(df, metrics={"closeness": closeness}, n_boot=40).first()
    value = 1 - np.abs(np.array(y) - np.array(p)).mean()
    assert r.metric == "closeness" and r.value == pytest.approx(value) and r.ci_lower < value < r.ci_upper
    d = paired_bootstrap_delta(df, "y_true", "y_pred_proba", "half", closeness, n_boot=40).first()
    assert d.metric == "closeness" and d.delta == pytest.approx(value - 0.5) and d.ci_lower <= d.delta <= d.ci_upper
    auc = paired_bootstrap_delta(df, "y_true", "y_pred_proba", "half", n_boot=40).first()
    assert auc.delta == pytest.approx(_auc_brute(y, p) - 0.5)


def test_log_loss_clips_at_double_epsilon(spark):
    eps = np.finfo(float).eps
    r = M.point_metrics(_frame(spark, [1, 0], [0.0, 0.0])).first()
    assert r.log_loss == pytest.approx((-np.log(eps) - np.log(1 - eps)) / 2)


def test_histogram_spans_the_values(spark):
    from crease.operators.calibration import probability_histogram
    p = np.round(np.random.default_rng(2).uniform(0.40, 0.49, 80), 4)
    p[p > 0.46] = 0.49  # leaves bins empty
    got = sorted((r.bin, r.bin_start, r["count"], r.density) for r in probability_histogram(
        _frame(spark, [0] * 80, p.tolist())).collect())
    counts, edges = np.histogram(p, bins=10)
    density, _ = np.histogram(p, bins=10, density=True)
    assert [g[2] for g in got] == counts.tolist() and 0 in counts
    assert [g[1] for g in got] == pytest.approx(edges[:-1].tolist()) and [g[3] for g in got] == pytest.approx(density.tolist())
    one = probability_histogram(_frame(spark, [0, 1], [0.3, 0.3])).collect()
    assert sorted((r.bin, r["count"]) for r in one) == [(i, 2 if i == 5 else 0) for i in range(10)]


def test_close_scores_are_spread_over_many_cells(spark):
    from crease.operators.ordered import cell, span
    rng = np.random.default_rng(9)
    p = np.round(rng.uniform(0.500, 0.503, 400), 6)
    df = _frame(spark, rng.integers(0, 2, 400).tolist(), p.tolist())
    cells = df.select(cell(F.col("y_pred_proba"), span(df, "y_pred_proba")).alias("c")).distinct().count()
    assert cells > 200
    y = [r.y_true for r in df.orderBy("rid").collect()]
    assert M.roc_auc(df).first()[0] == pytest.approx(_auc_brute(y, p.tolist()))


def test_prefix_sums_keep_null_partitions_and_break_ties(spark):
    rows = [(None, 1, 5, 10), (None, 1, 3, 1), ("a", 2, 1, 7), ("a", 1, 9, 2), (None, 0, 0, 4)]
    df = spark.createDataFrame(rows, "k string, day int, m long, v long")
    got = {(r.k, r.day, r.m): r.cum_v for r in prefix_sums(df, "day", ["v"], ["k"], inclusive=False, then=["m"]).collect()}
    assert got == {(None, 0, 0): 0, (None, 1, 3): 4, (None, 1, 5): 5, ("a", 1, 9): 0, ("a", 2, 1): 2}


def test_row_numbers_of_numeric_and_text_groups(spark):
    from crease.operators.ordered import with_row_number
    rng = np.random.default_rng(4)
    rows = [(int(g), f"match-{g:04d}-{'x' * (g % 5)}", i) for i, g in enumerate(rng.integers(0, 60, 500))]
    df = spark.createDataFrame(rows, "m long, t string, i long")
    for group in ("m", "t"):
        got = {r.i: r.n for r in with_row_number(df, group, ["i"], "n").collect()}
        order = sorted(rows, key=lambda r: (r[0] if group == "m" else r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, 501))


def test_ece_by_hand_and_curve_in_range(spark):
    df = _frame(spark, [0, 1, 1, 1], [0.15, 0.12, 0.95, 0.91])
    # two bins: |1/2 - 0.135| and |1 - 0.93|, half the rows each
    assert expected_calibration_error(df).first()[0] == pytest.approx((0.365 + 0.07) / 2)
    for r in calibration_curve(_frame(spark, *_noisy(90, 8)), n_bins=4).collect():
        assert 0 <= r.fraction_of_positives <= 1 and 0 <= r.mean_predicted_value <= 1


def test_calibrators(spark):
    df = _frame(spark, *_noisy(160, 21))
    for method in ("platt", "isotonic"):
        cal = fit_calibrator(df, method=method)
        out = [r.y_pred_calibrated for r in apply_calibrator(df, cal, method=method).collect()]
        assert all(0 <= v <= 1 for v in out)
    iso = apply_calibrator(df, fit_calibrator(df, method="isotonic"), method="isotonic") \
        .orderBy("y_pred_proba").select("y_pred_calibrated").collect()
    vals = [r[0] for r in iso]
    assert vals == sorted(vals)
    with pytest.raises(ValueError):
        fit_calibrator(df, method="bogus")
    same = calibrate_model(None, df)
    assert same.filter(F.col("y_pred_calibrated") != F.col("y_pred_proba")).count() == 0


def test_platt_gradient_vanishes_at_the_fit_only(spark):
    from crease.operators.calibration import PlattCalibrator, platt_fit, platt_gradient
    df = _frame(spark, *_noisy(200, 6))
    fit = platt_fit(df)
    assert all(abs(r.gradient) < 1e-6 for r in platt_gradient(df, fit).collect())
    assert any(abs(r.gradient) > 1e-3 for r in platt_gradient(df, PlattCalibrator(fit.a + 1, fit.b)).collect())
