import pytest
from pyspark.sql import functions as F

from crease.operators import features as FE
from crease.operators.ratings import player_ratings, player_volume
from crease.schema import METRIC_COLUMNS


def test_negative_correlation_keeps_weight(spark):
    rows = []
    for i, (won, dot) in enumerate([(1, 10.0), (0, 30.0), (1, 15.0), (0, 35.0)]):
        vals = {m: 0.0 for m in METRIC_COLUMNS}
        vals["dot_percentage"] = dot
        rows.append((i, 2020, "T", f"p{i}", won, *[vals[m] for m in METRIC_COLUMNS]))
    df = spark.createDataFrame(rows, "match_id long, season int, team string, player string, team_won int, "
                               + ", ".join(f"{m} double" for m in METRIC_COLUMNS))
    out = FE.composite_indices(df).collect()
    for r in out:
        assert r.batting_index == pytest.approx(r.dot_percentage)
    w = [r.weight for r in FE.weights_table(FE.correlation_weights(df)).collect()]
    assert sum(w) == pytest.approx(1.0)


def test_zero_weights_fall_back_to_uniform_and_constant_rating(spark):
    df = spark.createDataFrame([(1, "p", "T", 2020, 1, 1.0, 3.0, 0.0, 0.0), (2, "p", "T", 2020, 0, 2.0, 4.0, 0.0, 0.0)],
                               "match_id long, player string, team string, season int, team_won int, "
                               "feature_one double, feature_two double, batting_index double, bowling_index double")
    r = player_ratings(df, {"feature_one": 0.0, "feature_two": 0.0}).first()
    assert r.impact_score == pytest.approx(2.5) and r.impact_rating == 50.0


def test_ratings_span_zero_to_hundred(spark):
    df = spark.createDataFrame([(i, f"p{i}", "T", 2020, 0, float(i)) for i in range(5)],
                               "match_id long, player string, team string, season int, team_won int, x double")
    got = sorted(r.impact_rating for r in player_ratings(df, {"x": 1.0}).collect())
    assert got[0] == 0.0 and got[-1] == 100.0


def test_seasons_kept_apart(spark):
    df = spark.createDataFrame([(1, "Player X", "Team A", 2020, 10, 24), (2, "Player X", "Team A", 2021, 20, 18)],
                               "match_id long, player string, team string, season int, balls_faced long, "
                               "balls_bowled long")
    got = {r.season: (r.balls_faced, r.balls_bowled) for r in player_volume(df).collect()}
    assert got == {2020: (10.0, 24.0), 2021: (20.0, 18.0)}


def test_safe_divide_zero_denominator(spark):
    from crease.functions.expressions import safe_divide
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_divide("a", "b")).collect()] == [0.0, 0.0, 1.5]
