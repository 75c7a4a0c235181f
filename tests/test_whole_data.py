"""Nothing is cut, dropped or mixed up: large ids, missing values, all rows, all features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.functions.expressions import safe_divide, with_portable_uniform
from crease.operators import deliveries as D
from crease.operators import roles as R
from crease.operators.features import composite_indices, correlation_weights, feature_frame, prior_match_metrics
from crease.operators.playermatch import (
    batting_player_match, bowler_phase_stats, bowling_player_match, league_phase_rate, player_match_stats,
    player_phase_long,
)
from crease.operators.splits import rolling_origin_cv, rolling_origin_summary, stratified_split
from crease.schema import METRIC_COLUMNS


def test_kmeans_finds_k_groups_whatever_the_ids_residues(spark):
    rows = [(4 * i, float(i % 4) * 10 + (i % 3) * 0.01) for i in range(80)]
    res = R.kmeans_fit(spark.createDataFrame(rows, "rid long, a double"), ["a"], k=4)
    assert res.centroids.count() == 4 and res.assigned.select("cluster").distinct().count() >= 2
    few = R.kmeans_fit(spark.createDataFrame(rows[:3], "rid long, a double"), ["a"], k=4)
    assert few.centroids.count() == 3 and few.assigned.select("cluster").distinct().count() == 3


def test_kmeans_runs_to_a_fixed_point_no_dearer_than_spark_s_best(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, np.round(rng.normal(0, 1, 2), 1))) for i in range(600)]  # many rows are equal
    df = spark.createDataFrame(rows, "rid long, a double, b double")
    res = R.kmeans_fit(df, ["a", "b"], k=4, restarts=8)
    assert [r.misassigned for r in R.kmeans_check(res).collect()] == [0] * 4
    assert all(r.drift < 1e-9 for r in R.kmeans_check(res).collect())
    z, _, _ = R.standardise(df, ["a", "b"])
    x = np.array([(r.a_z, r.b_z) for r in z.orderBy("rid").collect()])
    centres = np.array([[(r.a - res.mean[0]) / res.std[0], (r.b - res.mean[1]) / res.std[1]] for r in res.centroids.collect()])
    cost = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    vec = VectorAssembler(inputCols=["a_z", "b_z"], outputCol="v").transform(z)
    best = min(KMeans(k=4, seed=s, featuresCol="v").fit(vec).summary.trainingCost for s in range(3))
    assert cost <= best * (1 + 1e-9)
    again = R.kmeans_fit(df.repartition(5), ["a", "b"], k=4, restarts=8)
    assert {r.rid: r.cluster for r in again.assigned.collect()} == {r.rid: r.cluster for r in res.assigned.collect()}


def test_kmeans_reads_distinct_vectors_only(spark, monkeypatch):
    from crease.operators import kmeans
    seen = []
    step = kmeans._step
    monkeypatch.setattr(kmeans, "_step", lambda points, *rest: seen.append(points.count()) or step(points, *rest))
    df = spark.range(5_000).selectExpr("id rid", "CAST(id % 6 AS DOUBLE) a")
    res = R.kmeans_fit(df, ["a"], k=3)
    assert set(seen) == {6} and sorted(r.a for r in res.centroids.collect()) == pytest.approx([0.5, 2.5, 4.5])


def test_uniform_numbers_tell_ids_apart_over_the_whole_range(spark):
    m = 2**31 - 1
    ids = [5, 5 + m, 5 + 2 * m, 5 + (1 << 40) * m // (1 << 20), 2**62 + 7]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    for salt in (0, 1, 999):
        u = [r.u for r in with_portable_uniform(df, "i", salt, out="u").collect()]
        assert len(set(u)) == len(ids) and all(0 <= x < 1 for x in u)


def test_stratified_split_keeps_null_labels_and_large_ids(spark):
    rows = [(10**12 + i * (2**31 - 1), [0, 1, None][i % 3]) for i in range(150)]
    out = stratified_split(spark.createDataFrame(rows, "rid long, y int"), "y", "rid", 0.2)
    got = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert got == {(y, s): n for y in (0, 1, None) for s, n in (("test", 10), ("train", 40))}


def test_prior_metrics_order_large_match_ids_and_keep_null_players(spark):
    rows = [(10**11 + 5, "2020-04-02", "p", 10.0), (3, "2020-04-03", "p", 20.0), (10**11 + 4, "2020-04-02", "p", 40.0),
            (7, "2020-04-01", None, 1.0), (8, "2020-04-05", None, 2.0)]
    df = spark.createDataFrame(rows, "match_id long, date string, player string, runs_scored double") \
        .withColumn("date", F.to_date("date"))
    for c in ("balls_faced", "dismissals", "wickets", "balls_bowled", "runs_conceded"):
        df = df.withColumn(c, F.lit(1.0))
    got = {(r.player, r.match_id): (r.prior_matches, r.prior_runs) for r in prior_match_metrics(df).collect()}
    assert got == {("p", 10**11 + 4): (0, 0.0), ("p", 10**11 + 5): (1, 40.0), ("p", 3): (2, 50.0), (None, 7): (0, 0.0),
                   (None, 8): (1, 1.0)}


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("NaN", nan), ("x", 1.0), (" 4 ", nan), (None, 2.0)], "runs_batter string, valid_ball double")
    out = D.valid_ball_flag(D.numeric_coerce(df, ["runs_batter", "runs_total"]))
    assert [(r.runs_batter, r.runs_total, r.valid_ball) for r in out.collect()] == \
        [(0.0, 0.0, 0), (0.0, 0.0, 1), (4.0, 0.0, 0), (0.0, 0.0, 2)]
    pairs = spark.createDataFrame([(nan, 1.0), (1.0, nan), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in pairs.select(safe_divide("a", "b")).collect()] == [0.0, 0.0, 0.0, 1.5]
    rows = [(i, 2020, "T", f"p{i}", i % 2, *[float(i) if j else nan for j in range(len(METRIC_COLUMNS))]) for i in range(6)]
    f = spark.createDataFrame(rows, "match_id long, season int, team string, player string, team_won int, "
                              + ", ".join(f"{m} double" for m in METRIC_COLUMNS))
    weights = correlation_weights(f).first().weights
    assert sum(weights) == pytest.approx(1.0) and weights[0] == 0.0
    assert all(np.isfinite(r.overall_index) for r in composite_indices(f).collect())
    assert composite_indices(f.drop(METRIC_COLUMNS[2])).count() == 6


def balls(spark, rows):
    return spark.createDataFrame(rows, "match_id long, season int, batting_team string, bowling_team string, batter string, "
                                 "bowler string, runs_batter double, runs_total double, valid_ball int, is_dot_ball boolean, "
                                 "is_four boolean, is_six boolean, is_boundary boolean, batter_dismissed boolean, "
                                 "is_bowler_wicket boolean, phase string, win_team string")


def ball(match, team, other, batter, bowler, runs, phase, season=2020):
    return (match, season, team, other, batter, bowler, float(runs), float(runs), 1, runs == 0, runs == 4, runs == 6,
            runs in (4, 6), False, False, phase, "A")


def test_null_phase_and_one_league_rate(spark):
    d = balls(spark, [ball(1, "A", "B", "a1", "b1", 1, "Middle"), ball(1, "A", "B", "a1", "b1", 4, None),
                      ball(1, "A", "B", "a2", "b2", 2, "Middle"), ball(None, "A", "B", "a2", "b2", 6, "Middle"),
                      ball(1, "A", None, "a2", "b3", 0, "Death")])
    rates = {r.phase: r.league_run_rate for r in league_phase_rate(bowler_phase_stats(player_phase_long(d))).collect()}
    # b2 bowled 2 balls for 8 in the middle overs, one of them in a match without an id
    assert rates == {"Middle": (6.0 + 24.0) / 2, "Death": 0.0}
    got = {(r.team, r.player): r for r in player_match_stats(d).collect()}
    assert got[("B", "b1")].phase_runs == {"Middle": 1.0} and got[("B", "b1")].runs_conceded == 5.0
    assert got[("B", "b1")].phase_efficacy == pytest.approx(15.0 - 6.0)
    assert got[("B", "b2")].phase_efficacy == pytest.approx(15.0 - 12.0)
    assert got[("A", "a1")].phase_efficacy == 0.0 and got[("A", "a1")].phases == {"Middle": 1.0}


def test_direct_sides_equal_the_joint_table_with_one_exchange(spark):
    rng = np.random.default_rng(2)
    rows = [ball(int(rng.integers(1, 4)), t, o, f"{t}{rng.integers(3)}", f"{o}{rng.integers(3)}", int(rng.integers(0, 7)),
                 ["Middle", "Death"][rng.integers(2)]) for t, o in [("A", "B"), ("B", "A")] for _ in range(60)]
    d = balls(spark, rows)
    both = player_match_stats(d)
    for side, rest in ((batting_player_match(d), "right_only"), (bowling_player_match(d), "left_only")):
        assert side._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        want = both.filter(F.col("_merge") != rest).select(*side.columns)
        assert sorted(map(tuple, side.collect())) == sorted(map(tuple, want.collect()))


def test_logistic_baseline_uses_its_list_and_caps_nothing(spark):
    from crease.operators.baselines import LOGISTIC_FEATURES, logistic_baseline, logistic_features, logistic_gradient
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(9)]
    rows = [(i, int(rng.random() < 0.5), *map(float, rng.normal(0, 1, 9))) for i in range(120)]
    df = spark.createDataFrame(rows, "match_id long, team_won int, " + ", ".join(f"{c} double" for c in names))
    assert logistic_features(df, "team_won") == names
    fit = logistic_baseline(df, "team_won", names)
    assert fit.features == names and len(fit.coefficients) == 9
    assert all(abs(r.gradient) < 1e-5 for r in logistic_gradient(df, fit, "team_won").collect())
    named = df.withColumnsRenamed(dict(zip(names, LOGISTIC_FEATURES[::-1])))
    assert logistic_features(named, "team_won") == LOGISTIC_FEATURES


def test_every_row_is_explained_in_several_tasks_and_missing_features_too(spark):
    from crease.operators.boosting import with_margins
    from crease.operators.explain import shap_values
    from crease.operators.model import train_impact_model
    rng = np.random.default_rng(5)
    X = rng.random((2300, 3))
    rows = [(i, int(X[i, 0] > X[i, 1]), *[None if i % 97 == 0 and j == 1 else float(X[i, j]) for j in range(3)])
            for i in range(2300)]
    cols = ["f0", "f1", "f2"]
    df = spark.createDataFrame(rows, "rid long, team_won int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    art = train_impact_model(df.dropna(), cols, params={"rounds": 3})
    values = shap_values(df, art.model, cols, keep=["rid"])
    assert values.rdd.getNumPartitions() > 1 and values.count() == 2300
    raw = with_margins(df, art.model, "raw").select("rid", "raw")
    assert values.join(raw, "rid").filter(F.abs(F.col("margin") - F.col("raw")) > 1e-9).count() == 0
    art.release()
    assert not art.persisted


def test_dates_in_several_formats(spark):
    texts = ["2008-04-18", "18/04/2008", "18-04-2008", "18.04.2008", "Apr 18, 2008", "April 18, 2008", "18 Apr 2008",
             "2008/04/18", "20080418", "2008-04-18 20:00:00", " 04/18/2008 "]
    df = spark.createDataFrame([(t,) for t in texts + ["tomorrow", "", None, "31/02/2008"]], "date string")
    got = [r.date for r in D.parse_date(df).collect()]
    assert [str(d) for d in got[:len(texts)]] == ["2008-04-18"] * len(texts) and got[len(texts):] == [None] * 4


def test_csv_types_come_from_names(spark, tmp_path):
    from crease.sources.deliveries import DataUnavailableError, scan_deliveries
    path = tmp_path / "balls.csv"
    path.write_text("Unnamed: 0,matchid,Season,striker,batsman_runs,ball,extra\n0,7,2007/08,x,4,6.1,e\n1,8,2009,y,oops,6.2,\n")
    df = scan_deliveries(spark, str(path))
    assert dict(df.dtypes) == {"matchid": "bigint", "Season": "string", "striker": "string", "batsman_runs": "int",
                               "ball": "string", "extra": "string"}
    assert [tuple(r) for r in df.collect()] == [(7, "2007/08", "x", 4, "6.1", "e"), (8, "2009", "y", None, "6.2", None)]
    (tmp_path / "empty.csv").write_text("match_id,batter\n")
    with pytest.raises(DataUnavailableError):
        scan_deliveries(spark, str(tmp_path / "empty.csv"))


def test_rolling_summary_equals_copied_rows(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, 2010 + int(rng.integers(0, 6)), int(rng.integers(0, 2))) for i in range(300)],
                               "rid long, season int, y_true int")
    want = {(r.fold, r.role): (r.n, pytest.approx(r.w)) for r in rolling_origin_cv(df).groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.avg("y_true").alias("w")).collect()}
    got = {(r.fold, r.role): (r.n_samples, r.win_rate) for r in rolling_origin_summary(df).collect()}
    assert got == want and len(got) == 9


def test_explorer_floor_is_never_above_the_largest_workload(spark):
    from crease.operators.team import player_explorer_filter
    df = spark.createDataFrame([("a", "T", 2020, 9.0, 0.0, "Anchor"), ("b", "", 2020, 4.0, 5.0, "Anchor"),
                                ("c", "T", 2020, 1.0, 0.0, "Anchor")],
                               "player string, team string, season int, balls_faced double, balls_bowled double, "
                               "primary_role string")
    got = {(r.player, r.team) for r in player_explorer_filter(df).collect()}
    assert got == {("a", "T"), ("b", "Unlisted")}


def test_cluster_folder_must_be_named(spark, monkeypatch):
    from crease import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_feature_frame_fills_what_is_missing(spark):
    d = balls(spark, [ball(1, "A", "B", "a1", "b1", 4, "Middle")])
    for r in feature_frame(player_match_stats(d)).collect():
        assert None not in (r.runs_scored, r.balls_bowled, r.bowling_economy, r.phase_efficacy)


def _tiny_lineitem(spark, path):
    rows = [(None if i % 17 == 16 else (i * 37) % 300, i % 40, i % 9, 1 + i % 4, float(i % 13), (i % 11) / 100, (i % 9) / 100,
             "ANR"[i % 3], "FO"[i % 2]) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string") \
        .repartition(5).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_match_rows_have_the_winners_of_the_balls(spark, tmp_path):
    from crease.plans import base
    from crease.sources.deliveries import fixture_deliveries, fixture_winners
    folder = _tiny_lineitem(spark, tmp_path / "t")
    columns = ["match_id", "venue", "date", "batting_team", "bowling_team", "win_team"]
    balls = base.deliveries(spark, folder)
    assert sorted(map(str, base.matches(spark, folder).select(*columns).collect())) == \
        sorted(map(str, balls.select(*columns).distinct().collect()))
    winners = fixture_winners(spark, folder)
    assert "Window" not in winners._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, winners.collect())) == sorted(map(str, fixture_deliveries(spark, folder).select(
        "match_id", "winner").distinct().collect()))


def test_balls_are_dealt_by_match_before_they_are_added_up(spark, tmp_path):
    from crease.plans import base
    long = player_phase_long(base.deliveries(spark, _tiny_lineitem(spark, tmp_path / "t")))
    plan = long._jdf.queryExecution().sparkPlan().toString()
    full = long._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 1
    assert full.index("Generate explode") < full.index("Exchange hashpartitioning")  # under it
    assert "Window" not in plan


def test_player_match_rows_are_brought_together_where_their_balls_were_added_up(spark, tmp_path):
    from crease.operators.playermatch import phase_rows, player_match_sums
    from crease.plans import base
    folder = _tiny_lineitem(spark, tmp_path / "t")
    long = player_phase_long(base.deliveries(spark, folder))
    sums = player_match_sums(long)
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    base.stats(spark, folder)
    assert "sums" in {key[2] for key in base._MEMO if key[1] == folder}
    rows = long.collect()
    assert any(r.match_id is None for r in rows)
    want = {}
    for r in rows:
        of = want.setdefault((r.match_id, r.season, r.team, r.player), {"bat": [None, 0], "bowl": [None, 0]})
        runs, balls = of[r.role]
        of[r.role] = [(runs or 0) + (r.runs_bat if r.role == "bat" else r.runs_tot), balls + r.balls]
    got = {tuple(r)[:4]: {"bat": [r.runs_scored, r.balls_faced or 0], "bowl": [r.runs_conceded, r.balls_bowled or 0]}
           for r in sums.collect()}
    assert got == want
    assert sorted(map(str, phase_rows(sums).collect())) == sorted(map(str, long.filter("phase IS NOT NULL").select(
        "match_id", "season", "team", "player", "role", "phase", "runs_tot", "balls").collect()))


def test_the_share_of_a_task_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from crease.operators.ordered import with_row_number
    from crease.plans import base
    from crease.session import partitions_for
    sizes = {n: partitions_for(spark, n, 250_000, 2_000_000) for n in (0, 600_000, 36_000_000, 216_000_000, 10 ** 9)}
    assert sizes == {0: None, 600_000: None, 36_000_000: 144, 216_000_000: 200, 10 ** 9: 500}
    one, other = (_tiny_lineitem(spark, tmp_path / name) for name in ("one", "other"))

    def rows(folder):  # the league's rates are means, whose last bits hang on the order of the bowlers
        return sorted(map(str, base.stats(spark, folder).withColumn("phase_efficacy", F.round("phase_efficacy", 9)).collect()))

    plain = rows(one)
    monkeypatch.setattr(base, "BALLS_OF_TASK", (10, 10))
    monkeypatch.setattr(base, "NUMBERED_OF_TASK", (3, 3))
    n = -(-base.deliveries(spark, other).count() // 10)
    assert n > 4  # the session's partitions
    plan = base.phase_long(spark, other)._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan
    assert rows(other) == plain and len(plain) > 12
    numbered = with_row_number(spark.createDataFrame([(i % 7, i) for i in range(30)], "m long, i long"), "m", ["i"], "n", 9)
    assert ", 9), REPARTITION_BY_NUM" in numbered._jdf.queryExecution().executedPlan().toString()
    assert [r.n for r in numbered.orderBy("m", "i").collect()] == [*range(1, 31)]
