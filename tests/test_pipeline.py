"""The end-to-end runs on a small season: training, a saved model, retraining."""

import pytest
from pyspark.sql import functions as F

from crease.operators.model import deterministic_seed, evaluate_model, find_model_dirs, load_model, read_metadata, save_model
from crease.plans.pipeline import retrain_and_save, run_pipeline

FEW = {"rounds": 3}


@pytest.fixture(scope="module")
def raw(spark):
    """Three matches of two teams of six; team A bats better, and player Z plays in two seasons."""
    rows = []
    for match, season in ((1, 2020), (2, 2020), (3, 2021)):
        for innings, (bat, bowl) in enumerate((("A", "B"), ("B", "A")), 1):
            for n in range(60):
                batter = "Z" if bat == "A" and n % 6 == 0 else f"{bat}{n % 6}"
                runs = (n * 7 + match) % (7 if bat == "A" else 4)
                out = batter if (n + match) % 19 == 0 else None
                rows.append((match, str(season), f"{season}-04-0{match}", innings, n // 6 + 1, n % 6 + 1, batter,
                             f"{bowl}{n % 5}", bat, bowl, str(runs), str(runs), out, "bowled" if out else None, "A"))
    return spark.createDataFrame(rows, "Match_Id int, Season string, match_date string, innings int, over int, ball_number int, "
                                 "striker string, bowler string, bat_team string, bowl_team string, batsman_runs string, "
                                 "total_runs string, player_dismissed string, kind string, winner string")


@pytest.fixture(scope="module")
def outputs(spark, raw):
    out = run_pipeline(spark, raw, boosting=FEW)
    yield out
    out.release()


def test_run_keeps_seasons_apart_and_rates_everyone(spark, outputs):
    profiles = outputs.profiles.collect()
    z = {r.season: r.balls_faced for r in profiles if r.player == "Z"}
    assert z == {"2020": 20.0, "2021": 10.0}
    assert {r.impact_rating for r in outputs.ratings.collect()} >= {0.0, 100.0}
    assert {r.player for r in profiles} == {"Z", *(f"A{i}" for i in range(6)), *(f"B{i}" for i in range(6))} - {"A0"} | {"A0"}
    xi = outputs.best_xi.collect()
    assert len({r.player for r in xi}) == len(xi) == 11 and sorted(r.rank_in_xi for r in xi) == list(range(1, 12))
    assert set(outputs.model_metrics) == {"accuracy", "roc_auc"}
    assert outputs.importance.count() == 12 and outputs.classification_report.count() == 5
    assert outputs.batter_labels.count() == outputs.bowler_labels.count() == 4


def test_summary_is_written_as_json(spark, outputs):
    rows = spark.read.json(outputs.export_summary()).collect()
    sections = {r.section for r in rows}
    assert sections == {"model_metrics", "cluster_labels.batters", "cluster_labels.bowlers"} and len(rows) == 10


def test_saved_model_is_preferred_and_patterns_are_ordered(spark, raw, outputs, tmp_path):
    store = f"file://{tmp_path}/models"
    assert load_model(spark, store) is None and load_model(spark, store, fallback=lambda: "trained") == "trained"
    save_model(outputs.artifacts, f"{store}/best_model_b")
    save_model(outputs.artifacts, f"{store}/best_model_a")
    save_model(outputs.artifacts, f"{store}/best-model-metadata")
    save_model(outputs.artifacts, f"{store}/other")
    assert [p.rsplit("/", 1)[1] for p in find_model_dirs(spark, store)] == ["best_model_a", "best_model_b"]
    save_model(outputs.artifacts, f"{store}/best-model")
    assert find_model_dirs(spark, store)[0].endswith("/best-model")
    again = run_pipeline(spark, raw, model_dir=store)
    assert again.model_metrics == pytest.approx(outputs.model_metrics) and again.artifacts.test.count() == 0
    # no test rows: the importances come from all rows
    assert again.artifacts.train.count() == again.features.count() and again.profiles.count() == outputs.profiles.count()
    again.release()


def test_unreadable_models_and_metadata_are_passed_over(spark, outputs, tmp_path):
    (tmp_path / "best-model-broken" / "model").mkdir(parents=True)
    save_model(outputs.artifacts, f"{tmp_path}/best_model")
    model, meta = load_model(spark, str(tmp_path))
    assert meta["feature_columns"] == outputs.artifacts.feature_cols
    (tmp_path / "bad" / "metadata").mkdir(parents=True)
    (tmp_path / "bad" / "metadata" / "part-0.txt").write_text("{not json")
    assert read_metadata(spark, str(tmp_path / "bad")) == {} == read_metadata(spark, str(tmp_path / "none"))


def test_retrain_and_save(spark, raw, tmp_path):
    metrics = retrain_and_save(spark, raw, f"{tmp_path}/best_model", boosting=FEW)
    model, meta = load_model(spark, str(tmp_path))
    assert meta["metrics"] == pytest.approx(metrics) and len(meta["feature_columns"]) == 12


def test_evaluation_of_raw_and_calibrated_scores(spark):
    rows = [(i, i % 2, 0.3 + 0.4 * (i % 2) + 0.02 * (i % 5)) for i in range(60)]
    test = spark.createDataFrame(rows, "rid long, team_won int, y_pred_proba double").withColumn(
        "better", F.when(F.col("team_won") == 1, 0.95).otherwise(0.05))
    raw_metrics = {r.metric: r.value for r in evaluate_model(test, n_boot=20).collect()}
    assert "expected_calibration_error" not in raw_metrics and raw_metrics["accuracy"] == 1.0
    calibrated = {r.metric: r for r in evaluate_model(test, calibrated="better", n_boot=20).collect()}
    ece = calibrated["expected_calibration_error"]
    assert ece.value == ece.ci_lower == ece.ci_upper == pytest.approx(0.05)
    assert calibrated["brier_score"].value < raw_metrics["brier_score"]


def test_deterministic_seed():
    assert deterministic_seed() == 42 and deterministic_seed(7) == 7
