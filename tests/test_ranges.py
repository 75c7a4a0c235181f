"""Cells cut at samples, interval joins, isotonic merging and replicate vectors against brute force."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from crease.operators import bootstrap as BS
from crease.operators import metrics as M
from crease.operators.intervals import first_match
from crease.operators.isotonic import isotonic_apply, isotonic_fit
from crease.operators.ordered import prefix_sums, splitters, with_cell, with_row_number


# ---------------------------------------------------------------- cells
def test_crowded_values_and_alike_texts_are_spread_over_all_cells(spark):
    crowded = spark.range(20_000).select((F.lit(0.5) + F.col("id") * 1e-9).alias("v")).unionByName(
        spark.createDataFrame([(0.0,), (1.0,)], "v double"))
    sizes = [r.n for r in with_cell(crowded, "v", splitters(crowded, "v")).groupBy("_cell").agg(
        F.count("*").alias("n")).collect()]
    assert len(sizes) > 3_000 and max(sizes) < 100
    texts = spark.range(1_000).select(F.format_string("match-%08d", "id").alias("v"))
    cells = with_cell(texts, "v", splitters(texts, "v"))
    assert cells.select("_cell").distinct().count() >= 999
    in_order = [r._cell for r in cells.orderBy("v").collect()]
    assert in_order == sorted(in_order)


def test_repeated_values_do_not_crowd_the_sample_and_nulls_have_a_cell(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(1.0,)] * 5_000 + [(float(i),) for i in range(100)], "v double")
    assert {r._cell for r in with_cell(df, "v", splitters(df, "v")).where("v IS NULL").collect()} == {0}
    assert with_cell(df, "v", splitters(df, "v")).select("_cell").distinct().count() >= 100


def test_prefix_sums_and_numbers_with_few_cells(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randint(0, 50) / 7, rng.randint(1, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, w long").groupBy("k", "v").agg(F.sum("w").alias("w"))
    for cells in (8, 4096):
        for descending in (False, True):
            for r in prefix_sums(df, "v", ["w"], ["k"], cells=cells, descending=descending).collect():
                ahead = [w for k, v, w in rows if k == r.k and (v >= r.v if descending else v <= r.v)]
                assert r.cum_w == sum(ahead)
    names = [f"match-{i:05d}" for i in range(300)]
    numbered = with_row_number(spark.createDataFrame([(n,) for n in names], "m string"), "m", ["m"]).collect()
    assert {r.m: r.rid for r in numbered} == {n: i + 1 for i, n in enumerate(names)}


# ---------------------------------------------------------------- interval join
def brute_match(value, bands):
    for low, high, closed, position, label in sorted(bands, key=lambda b: (b[3], b[0], b[1])):
        if None not in (value, low, high) and low <= value and (value < high or (closed and value == high)):
            return label
    return None


@pytest.mark.parametrize("limit", [2_000, 0])
def test_first_band_that_holds_a_value_wins(spark, limit):
    rng = random.Random(8)
    schema = "case string, low double, high double, closed boolean, position long, label string, clash int"
    table = {case: [(rng.randint(0, 30) / 2, rng.randint(0, 30) / 2, rng.random() < 0.5, rng.randint(0, 9), f"{case}{i}")
                    for i in range(40)] + [(None, 3.0, True, 0, "none"), (2.0, None, True, 0, "none"),
                                           (7.0, 7.0, True, -1, "point"), (8.0, 8.0, False, -1, "empty")]
             for case in ("x", "y")}
    # bands of one position and border would tie
    table = {case: [(lo, hi, c, p * 100 + i, label) for i, (lo, hi, c, p, label) in enumerate(rows)]
             for case, rows in table.items()}
    bands = spark.createDataFrame([(case, *row, 1) for case, rows in table.items() for row in rows], schema)
    values = [None, float("nan"), -1.0, 99.0, *[i / 4 for i in range(70)]] * 2
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "rid long, v double").repartition(3)
    found = first_match(df, "v", bands, by="case", broadcast_segments=limit).collect()
    assert len(found) == 2 * len(values)
    for r in found:
        value = None if r.v is None or r.v != r.v else r.v
        assert r.label == brute_match(value, table[r.case]), r
    alone = first_match(df, "v", bands.where("case = 'x'").drop("case"), broadcast_segments=limit)
    assert alone.columns == ["rid", "v", "label"]
    assert {r.rid: r.label for r in alone.collect()} == {r.rid: r.label for r in found if r.case == "x"}
    assert first_match(df, "v", bands.limit(0).drop("case")).where("label IS NOT NULL").count() == 0


# ---------------------------------------------------------------- isotonic
def max_min(points):
    """Isotonic regression by its max-min formula, on distinct ascending scores (score, weight, total)."""
    return [max(min(sum(t for _, _, t in points[a:b + 1]) / sum(w for _, w, _ in points[a:b + 1])
                    for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]


@pytest.mark.parametrize("kind", ["noisy", "falling", "rising", "ties"])
def test_merged_pools_equal_the_max_min_formula(spark, kind):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(120), 1 if kind == "ties" else 3)
    y = {"noisy": rng.random(120) < p, "ties": rng.random(120) < p, "falling": p < 0.5, "rising": p > 0.5}[kind].astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [(-1, None, 0.3), (-2, 1, None)],
                               "rid long, y_true int, y_pred_proba double").repartition(3)
    model = isotonic_fit(df)
    points = [(s, int((p == s).sum()), int(y[p == s].sum())) for s in np.unique(p)]
    told = dict(zip(np.unique(p).tolist(), max_min(points)))
    asked = spark.createDataFrame([(float(s),) for s in [*np.unique(p), -1, 2, *((np.unique(p)[1:] + np.unique(p)[:-1]) / 2)]]
                                  + [(None,)], "y_pred_proba double")
    found = {r.y_pred_proba: r.y_pred_calibrated for r in isotonic_apply(asked, model).collect()}
    assert len(found) == asked.count() and found.pop(None) is None
    scores = np.unique(p)
    for score, value in found.items():
        assert value == pytest.approx(np.interp(score, scores, [told[s] for s in scores.tolist()]), abs=1e-12), score


def test_isotonic_over_many_ranges_and_an_empty_fit(spark):
    df = spark.range(30_000).select(F.col("id").alias("rid"), (F.rand(5) * 0.9 + 0.05).alias("y_pred_proba"), F.rand(6).alias("u"))
    df = df.select("rid", "y_pred_proba", (F.col("u") < F.col("y_pred_proba") ** 2).cast("int").alias("y_true"))
    df = spark.createDataFrame(df.collect(), df.schema)
    model = isotonic_fit(df)
    rows = df.orderBy("y_pred_proba").toPandas()
    stack = []
    for s, y in zip(rows.y_pred_proba, rows.y_true):
        stack.append([s, s, 1.0, float(y)])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            last = stack.pop()
            stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    pools = [(r.lo, r.hi, r.value) for r in model.pools.orderBy("lo").collect()]
    assert pools == [(lo, hi, t / w) for lo, hi, w, t in stack] and len(pools) > 20
    nothing = isotonic_fit(df.limit(0))
    assert isotonic_apply(df, nothing).where("y_pred_calibrated IS NOT NULL").count() == 0


# ---------------------------------------------------------------- replicate vectors
def scored(spark, n, seed, digits=None, parts=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(0.5 + 0.2 * (2 * y - 1) + rng.normal(0, 0.25, n), 0.001, 0.999)
    p = p if digits is None else np.round(p, digits)
    rows = [(i, int(a), float(b), int(b >= 0.5)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "rid long, y_true int, y_pred_proba double, y_pred int").repartition(parts)


@pytest.mark.parametrize("digits", [None, 1])
def test_vectors_equal_metrics_on_weighted_rows(spark, digits):
    df = scored(spark, 400, 21, digits)
    groups = BS._stored(BS.score_counts(df, "y_true", {"m": "y_pred"}, {"m": "y_pred_proba"}), "groups")
    found = {r.replicate: r for r in BS.replicate_metrics(groups, "m", "y_pred", "y_pred_proba",
                                                          [*BS.ALL_METRICS, "mae"], 12).collect()}
    weighted = BS.replicate_weights(groups, 12).withColumnsRenamed({"_y": "y", "_h_m": "h", "_p_m": "p"})
    told = M.binary_metrics(weighted, "y", "h", "p", ["replicate"], "w").collect()
    assert len(told) == len(found) == 12
    for r in told:
        for metric in (*BS.ALL_METRICS, "mae"):
            assert found[r.replicate][f"m:{metric}"] == pytest.approx(r[metric], rel=1e-9), metric


def test_group_numbers_of_near_scores_differ_and_equal_those_of_arrays(spark):
    pairs = [(0.501, 0.5), (0.5, 0.562), (0.5, 0.501), (0.25 + 2 ** -53, 0.5), (0.25, 0.5), (0.1, None), (3.5, -2.25)]
    df = spark.createDataFrame([(1, p, b) for p, b in pairs], "y int, p double, b double")
    groups = BS.with_group_number(df, ["p", "b", "y"])
    numbers = {(r.p, r.b): r._group for r in groups.collect()}
    assert len(set(numbers.values())) == len(pairs) and all(0 <= n < 1 << 62 for n in numbers.values())
    arrays = [np.array([np.nan if v is None else v for v in c]) for c in zip(*[(p, b, 1.0) for p, b in pairs])]
    assert BS.group_numbers(arrays).tolist() == [numbers[pair] for pair in pairs]
    # the two rows of round 2 that were always drawn together
    w = BS.Weights(1000, 42).draw(np.array([numbers[pairs[0]], numbers[pairs[1]]]), np.array([1, 1]))
    assert abs(np.corrcoef(w)[0, 1]) < 0.15


def test_poisson_weights_on_both_sides_of_the_exact_sums():
    numbers = np.arange(10_000, 10_400)
    for n in (1, 3, BS.EXACT_ROWS - 1, BS.EXACT_ROWS, 5_000):
        w = BS.Weights(300, 7).draw(numbers, np.full(len(numbers), n))
        assert w.mean() == pytest.approx(n, rel=0.02) and w.var() == pytest.approx(n, rel=0.05)
    low, table = BS.poisson_table(200)
    assert table[-1] == pytest.approx(1, abs=1e-12) and np.searchsorted(table, 0.5) + low == 200


def test_no_generator_over_replicates_is_planned(spark):
    df = scored(spark, 60, 2)
    groups = BS._stored(BS.score_counts(df, "y_true", {"m": "y_pred"}, {"m": "y_pred_proba"}), "groups")
    plan = BS.range_sums(BS.ranged_groups(groups, "m"), 50, 1)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
