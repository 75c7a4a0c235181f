import pytest
from pyspark.sql import functions as F

from crease.operators import splits as SP
from crease.operators.baselines import recent_form_baseline, venue_baseline


def test_time_split_counts_and_empty_error(spark):
    rows = [(i, 2018, 1) for i in range(50)] + [(50 + i, 2019, 0) for i in range(25)] + \
           [(75 + i, 2020, 1) for i in range(25)]
    df = spark.createDataFrame(rows, "match_id long, season int, team_won int")
    got = {r.split: r["count"] for r in SP.time_split(df).groupBy("split").count().collect()}
    assert got == {"train": 50, "val": 25, "test": 25}
    summ = {r.split: r for r in SP.split_summary(SP.time_split(df)).collect()}
    assert summ["total"].n_samples == 100 and summ["train"].seasons == "2018"
    only_2020 = spark.createDataFrame([(1, 2020, 1)], "match_id long, season int, team_won int")
    with pytest.raises(ValueError):
        SP.time_split(only_2020)


def test_non_integer_season_dropped(spark):
    df = spark.createDataFrame([(1, "2007/08", 1), (2, "2018", 0), (3, "2019", 1), (4, "2020", 0)],
                               "match_id long, season string, team_won int")
    assert SP.time_split(df).count() == 3


def test_rolling_origin_folds(spark):
    df = spark.createDataFrame([(i, 2015 + i // 40, i % 2) for i in range(200)], "match_id long, season int, y int")
    folds = SP.rolling_origin_folds(df, 3).collect()
    by = {}
    for r in folds:
        by.setdefault(r.test_season, {}).setdefault(r.role, []).append(r.season)
    assert sorted(by) == [2018, 2019]
    assert sorted(by[2018]["train"]) == [2015, 2016] and by[2018]["val"] == [2017]
    assert sorted(by[2019]["train"]) == [2015, 2016, 2017] and by[2019]["val"] == [2018]
    with pytest.raises(ValueError):
        SP.rolling_origin_folds(df.filter(F.col("season") <= 2017), 3)


def test_stratified_split_exact_share(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "rid long, y int")
    out = SP.stratified_split(df, "y", "rid", 0.2, 42)
    got = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert got[(1, "test")] == 20 and got[(0, "test")] == 40
    again = SP.stratified_split(df, "y", "rid", 0.2, 42).filter(F.col("split") == "test").select("rid")
    assert sorted(r.rid for r in again.collect()) == sorted(
        r.rid for r in out.filter(F.col("split") == "test").select("rid").collect())


def test_venue_prior(spark):
    rows = [(v, y) for _ in range(10) for v, y in (("A", 1), ("A", 1), ("B", 0), ("B", 1))]
    df = spark.createDataFrame(rows, "venue string, y_true int")
    pr = venue_baseline(df)
    got = {r.venue: r.prior for r in pr.table.collect()}
    assert got == {"A": 1.0, "B": 0.5}
    test = spark.createDataFrame([("A",), ("C",)], "venue string")
    out = {r.venue: r.p_baseline for r in pr.predict(test).collect()}
    assert out["A"] == 1.0 and out["C"] == pytest.approx(0.75)
    no_venue = venue_baseline(df.select("y_true"))
    assert no_venue.predict(test).first().p_baseline == pytest.approx(0.75)


def test_recent_form_window(spark):
    ys = [1, 1, 0, 1, 0] * 4
    rows = [("A" if i < 10 else "B", i, ys[i]) for i in range(20)]
    df = spark.createDataFrame(rows, "team string, match_id long, y_true int")
    pr = recent_form_baseline(df, window=3, order=("match_id",))
    got = {r.team: r.prior for r in pr.table.collect()}
    assert got["A"] == pytest.approx(1 / 3) and got["B"] == pytest.approx(1 / 3)
