"""The end-to-end batch runs: deliveries -> ratings, archetypes, best XI; and training for later use.

Everything before the model is one lazy plan; the player-match feature table
is written once as Parquet in the shared folder, as training, explanation,
ratings and both clusterings read it and it must survive the loss of an
executor. Driver round trips are bounded: the feature weights, k centroids per
iteration, importances and the XI's candidates. ``PipelineOutputs.release``
gives up what is kept in memory and removes the table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import roles as R
from crease.operators.deliveries import prepare_deliveries
from crease.operators.explain import importance_summary, shap_values
from crease.operators.features import composite_indices, correlation_weights, feature_frame, model_matrix
from crease.operators.metrics import classification_report
from crease.operators.model import ModelArtifacts, load_model, save_model, score, train_impact_model
from crease.operators.ordered import NUMBERED_OF_TASK, with_row_number
from crease.operators.playermatch import BALLS_OF_TASK, player_match_stats, player_match_sums, player_phase_long
from crease.operators.ratings import player_ratings, player_volume, top_ratings
from crease.operators.team import best_xi, player_profiles
from crease.session import partitions_for
from crease.sources.sinks import export_summary, remove_path, scratch_path


@dataclass
class PipelineOutputs:
    features: DataFrame
    model_metrics: dict
    importance: DataFrame
    ratings: DataFrame
    top_ratings: DataFrame
    profiles: DataFrame
    best_xi: DataFrame
    batter_labels: DataFrame
    bowler_labels: DataFrame
    classification_report: DataFrame
    artifacts: ModelArtifacts
    feature_path: str
    timings: dict = field(default_factory=dict)

    def export_summary(self, path: str | None = None) -> str:
        return export_summary(self.model_metrics, self.batter_labels, self.bowler_labels, path)

    def release(self) -> None:
        """After this the outputs can no longer be computed: keep what was written or collected."""
        self.artifacts.release()
        self.importance.unpersist()
        remove_path(self.features.sparkSession, self.feature_path)


def feature_table(spark: SparkSession, raw_deliveries: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Indexed player-match features with ``rid``, written as Parquet; (the table, its path).

    The sums per player-match are stored first, as the league's rates and the player-match rows are both taken from them, and
    the features before they are numbered, as numbering reads them several times."""
    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    balls = prepare_deliveries(raw_deliveries)
    steps = [scratch_path(spark, "sums"), scratch_path(spark, "unnumbered")]
    long = player_phase_long(balls, partitions_for(spark, balls.count(), *BALLS_OF_TASK))
    sums = stored(player_match_sums(long), steps[0])
    feats = stored(feature_frame(player_match_stats(balls, sums=sums)), steps[1])
    path = path or scratch_path(spark, "features")
    numbered = with_row_number(feats, "match_id", ["team", "player"],
                               partitions=partitions_for(spark, feats.count(), *NUMBERED_OF_TASK))
    table = stored(numbered, path)
    for step in steps:
        remove_path(spark, step)
    return composite_indices(table, correlation_weights(table)), path


def saved_artifacts(spark: SparkSession, model_dir: str, matrix: DataFrame, cols: list[str],
                    target: str = "team_won") -> ModelArtifacts | None:
    """The first saved model in ``model_dir`` over ``matrix`` (no test rows; metrics from its metadata), or None."""
    found = load_model(spark, model_dir)
    if found is None:
        return None
    model, meta = found
    features = [c for c in meta.get("feature_columns", cols) if c in matrix.columns]
    empty = score(model, matrix.limit(0))
    return ModelArtifacts(model, features, target, matrix, empty, meta.get("metrics", {}))


def run_pipeline(spark: SparkSession, raw_deliveries: DataFrame, seed: int | None = None,
                 boosting: dict | None = None, shap_sample: int | None = None,
                 model_dir: str | None = None) -> PipelineOutputs:
    """The whole run. A model saved in ``model_dir`` is preferred; without one (or without a folder) it is trained."""
    t = {}
    t0 = time.time()
    base, path = feature_table(spark, raw_deliveries)
    t["features"] = time.time() - t0

    t0 = time.time()
    matrix, cols = model_matrix(base)
    art = saved_artifacts(spark, model_dir, matrix, cols) if model_dir else None
    if art is None:
        art = train_impact_model(matrix, cols, seed=seed, params=boosting)
    t["train"] = time.time() - t0

    t0 = time.time()
    shap = shap_values(art.train, art.model, art.feature_cols, shap_sample)
    importance = importance_summary(shap, art.feature_cols).persist()
    weights = {r["feature"]: r["mean_abs_shap"] for r in importance.collect()}  # <= #features rows
    if not weights:
        weights = {c: 1.0 for c in cols}
    t["explain"] = time.time() - t0

    t0 = time.time()
    ratings = player_ratings(matrix, weights)
    bat = R.cluster_batters(base)
    bowl = R.cluster_bowlers(base)
    bl, wl = R.label_batter_clusters(bat.centroids), R.label_bowler_clusters(bowl.centroids)
    profiles = player_profiles(ratings, player_volume(base), R.cluster_mode(bat.assigned, "batter_cluster"),
                               R.cluster_mode(bowl.assigned, "bowler_cluster"), bl, wl)
    xi = best_xi(profiles)
    t["roles"] = time.time() - t0
    report = classification_report(art.test.withColumn("_y", F.col("team_won").cast("int")), "_y", "y_pred")
    return PipelineOutputs(base, art.metrics, importance, ratings, top_ratings(ratings, 25), profiles, xi,
                           bl, wl, report, art, path, t)


def retrain_and_save(spark: SparkSession, raw_deliveries: DataFrame, model_path: str, seed: int | None = None,
                     boosting: dict | None = None) -> dict:
    """Train on the deliveries and save the model with its metadata; its metrics."""
    base, path = feature_table(spark, raw_deliveries)
    matrix, cols = model_matrix(base)
    art = train_impact_model(matrix, cols, seed=seed, params=boosting)
    save_model(art, model_path)
    art.release()
    remove_path(spark, path)
    return art.metrics
