import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.operators import roles as R
from crease.operators.team import best_xi


def test_empty_clustering_keeps_columns(spark):
    df = spark.createDataFrame([], "rid long, feature_a double, feature_b double")
    res = R.kmeans_fit(df, ["feature_a", "feature_b"], 4)
    assert res.assigned.count() == 0 and "cluster" in res.assigned.columns
    assert res.centroids.count() == 0


def test_kmeans_separates_obvious_groups(spark):
    rows = [(i, float(i % 2) * 100 + (i % 5) * 0.1, 1.0) for i in range(40)]
    res = R.kmeans_fit(spark.createDataFrame(rows, "rid long, a double, b double"), ["a", "b"], k=2)
    got = {}
    for r in res.assigned.collect():
        got.setdefault(r.a >= 50, set()).add(r.cluster)
    assert len(got[True]) == 1 and len(got[False]) == 1 and got[True] != got[False]


def test_label_rules(spark):
    cents = spark.createDataFrame([(0, 150.0, 30.0, 20.0), (1, 100.0, 60.0, 10.0), (2, 90.0, 40.0, 50.0),
                                   (3, 80.0, 35.0, 5.0)],
                                  "cluster int, batting_strike_rate double, dot_percentage double, "
                                  "batting_average double")
    got = {r.cluster: r.label for r in R.label_batter_clusters(cents).collect()}
    assert got == {0: "Power Hitter", 1: "Anchor", 2: "Accumulator", 3: "Finisher"}


def test_primary_role(spark):
    df = spark.createDataFrame([(40.0, 20.0, "Anchor", "Strike Bowler"), (40.0, 0.0, "Anchor", None),
                                (0.0, 30.0, None, "Middle Overs"), (0.0, 0.0, None, None), (0.0, 0.0, None, "X")],
                               "balls_faced double, balls_bowled double, batter_role string, bowler_role string")
    got = [r[0] for r in df.select(R.primary_role()).collect()]
    assert got == ["Allrounder", "Anchor", "Middle Overs", "Specialist", "X"]


def test_best_xi_unique_and_balanced(spark):
    roles = ["Power Hitter"] * 8 + ["Allrounder"] * 4 + ["Strike Bowler"] * 8
    rows = []
    for i, role in enumerate(roles):
        for season in (2019, 2020):
            rows.append((f"p{i}", "T", season, float(100 - i - (season - 2019) * 0.5), role))
    prof = spark.createDataFrame(rows, "player string, team string, season int, impact_rating double, "
                                 "primary_role string")
    xi = best_xi(prof).collect()
    assert len(xi) == 11 and len({r.player for r in xi}) == 11
    by_role = {}
    for r in xi:
        by_role[r.primary_role] = by_role.get(r.primary_role, 0) + 1
    assert by_role == {"Power Hitter": 5, "Allrounder": 2, "Strike Bowler": 4}
    assert sorted(r.rank_in_xi for r in xi) == list(range(1, 12))


def test_treeshap_additivity(spark):
    from crease.operators.boosting import with_margins
    from crease.operators.explain import shap_values
    from crease.operators.model import train_impact_model
    rng = np.random.default_rng(0)
    X = rng.random((100, 5))
    y = (X[:, 0] + X[:, 1] > 1).astype(int)
    rows = [(i, int(y[i]), *map(float, X[i])) for i in range(100)]
    cols = [f"f{j}" for j in range(5)]
    df = spark.createDataFrame(rows, "rid long, team_won int, " + ", ".join(f"{c} double" for c in cols))
    art = train_impact_model(df, cols, params={"rounds": 5})
    sv = shap_values(art.train, art.model, cols, 20, keep=["rid"]).toPandas()
    assert sv.shape == (20, 5 + 3) and np.isfinite(sv[cols].to_numpy()).all()
    raw = with_margins(art.train, art.model, "m").select("rid", "m").toPandas()
    j = sv.merge(raw, on="rid")
    assert np.allclose(j["margin"], j["m"], atol=1e-9)
    assert np.allclose(sv[cols].sum(axis=1) + sv["base_value"], sv["margin"], atol=1e-9)


def test_nearest_centroid_holds_each_distance_once(spark):
    z = ["a_z", "b_z"]
    size = {k: len(R._nearest(z, [[float(j), 0.5] for j in range(k)])._jc.toString()) for k in (4, 8)}
    assert size[8] < 2.5 * size[4]
    df = spark.createDataFrame([(0.5, 0.5), (0.6, 0.5), (9.0, 0.5), (None, 0.5)], "a_z double, b_z double")
    got = [r.c for r in R.kmeans_assign(df, z, [[0.0, 0.5], [1.0, 0.5], [1.0, 0.5]], "c").collect()]
    assert got == [0, 1, 1, 0]  # of centroids as near the first, and the first for a row without a distance


def test_profiles_and_indices_are_made_once(spark, monkeypatch):
    from crease.plans import base
    made = []
    monkeypatch.setattr(base, "_profiles", lambda s, d: made.append("profiles") or s.range(3).withColumn("player", F.lit("x")))
    monkeypatch.setattr(base, "features", lambda s, d: made.append("features") or s.range(2))
    monkeypatch.setattr(base, "correlation_weights", lambda f: None)
    monkeypatch.setattr(base, "composite_indices", lambda f, w: f)
    folder = "nowhere-r03"
    for _ in range(2):
        assert base.profiles(spark, folder).count() == 3 and base.indexed(spark, folder).count() == 2
    assert sorted(made) == ["features", "profiles"]
    for name in ("profiles", "indexed"):
        key = (spark.sparkContext.applicationId, folder, name)
        base._MEMO.pop(key)
        base.remove_path(spark, base._PATHS.pop(key))
