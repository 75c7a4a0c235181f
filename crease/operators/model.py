"""Win model: second-order boosted trees, evaluation, persistence."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators.boosting import NODE_SCHEMA, BoostedTrees, BoostingParams, fit_boosted_trees, with_margins
from crease.operators.bootstrap import ALL_METRICS, bootstrap_metrics
from crease.operators.calibration import expected_calibration_error
from crease.operators.metrics import binary_metrics
from crease.operators.splits import stratified_split

DEFAULT_SEED = 42

# Boosting settings of the win model.
BOOSTING = dict(rounds=300, max_depth=4, learning_rate=0.05, subsample=0.8, colsample=0.8, l2=1.0)

# Name patterns of saved models, tried in this order; names with this word hold metadata.
MODEL_PATTERNS = ("best-model*", "best_model*")
METADATA_WORD = "metadata"


def deterministic_seed(seed: int | None = None) -> int:
    """The library-wide seed (42 unless given) that training and splits use."""
    return DEFAULT_SEED if seed is None else int(seed)


@dataclass
class ModelArtifacts:
    model: BoostedTrees
    feature_cols: list[str]
    target: str
    train: DataFrame
    test: DataFrame
    metrics: dict = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give up the frames kept in memory; ``train`` and ``test`` stay usable and are computed again."""
        for df in self.persisted:
            df.unpersist()
        self.persisted = []


def score(model: BoostedTrees, df: DataFrame, proba: str = "y_pred_proba", pred: str = "y_pred") -> DataFrame:
    """``df`` with the probability of label 1 and the label it says."""
    out = with_margins(df, model, "_margin")
    return (out.withColumn(proba, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin"))))
            .withColumn(pred, (F.col(proba) >= 0.5).cast("int")).drop("_margin"))


def train_impact_model(model_df: DataFrame, feature_cols: Sequence[str], target: str = "team_won",
                       test_size: float = 0.2, seed: int | None = None, split_col: str | None = None,
                       id_col: str = "rid", params: dict | None = None) -> ModelArtifacts:
    """Fit boosted trees on a stratified (default) or given train/test split,
    score the test rows and compute accuracy and ROC AUC (one small row)."""
    seed = deterministic_seed(seed)
    feature_cols = list(feature_cols)
    if split_col:
        split = model_df
    else:
        split = stratified_split(model_df, target, id_col, test_size, seed)
        split_col = "split"
    # fit, scoring and metrics all read the split: materialise it once
    split = split.persist()
    train = split.filter(F.col(split_col) == "train")
    test = split.filter(F.col(split_col) == "test")
    model = fit_boosted_trees(train, feature_cols, target, id_col,
                              BoostingParams(**{**BOOSTING, "seed": seed, **(params or {})}))
    scored_test = score(model, test).persist()
    m = binary_metrics(scored_test.withColumn("_y", F.col(target).cast("int")), "_y", "y_pred", "y_pred_proba") \
        .select("accuracy", "roc_auc").first()
    return ModelArtifacts(model, feature_cols, target, train, scored_test,
                          {"accuracy": m["accuracy"], "roc_auc": m["roc_auc"]}, [split, scored_test])


def evaluate_model(test: DataFrame, target: str = "team_won", p: str = "y_pred_proba", calibrated: str | None = None,
                   metrics: Sequence[str] = ALL_METRICS, n_boot: int = 1000, confidence: float = 0.95,
                   seed: int | None = None) -> DataFrame:
    """``(metric, value, ci_lower, ci_upper)`` of the raw scores, or of the column ``calibrated``; then with
    ``expected_calibration_error``, which has no interval of its own."""
    score_col = calibrated or p
    d = test.select(F.col(target).cast("int").alias("_y"), F.col(score_col).cast("double").alias("_p"),
                    (F.col(score_col) >= 0.5).cast("int").alias("_h"))
    out = bootstrap_metrics(d, "_y", "_h", "_p", metrics, n_boot, confidence, deterministic_seed(seed))
    if calibrated is None:
        return out
    ece = expected_calibration_error(d, "_y", "_p").select(
        F.lit("expected_calibration_error").alias("metric"), F.col("ece").alias("value"),
        F.col("ece").alias("ci_lower"), F.col("ece").alias("ci_upper"))
    return out.unionByName(ece)


def _write_json(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(artifacts: ModelArtifacts, path: str) -> str:
    """Persist the model (its node table, features and base score) and a one-row JSON metadata record."""
    spark, model = artifacts.train.sparkSession, artifacts.model
    model.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model/nodes")
    _write_json(spark, {"feature_columns": model.feature_cols, "base": model.base}, f"{path}/model/spec")
    _write_json(spark, {"feature_columns": artifacts.feature_cols, "target": artifacts.target,
                        "metrics": {k: (None if v is None else float(v)) for k, v in artifacts.metrics.items()}},
                f"{path}/metadata")
    return path


def read_model(spark: SparkSession, path: str) -> BoostedTrees:
    spec = json.loads(spark.read.text(f"{path}/model/spec").first()[0])
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/model/nodes")
    return BoostedTrees.from_nodes(nodes, spec["feature_columns"], spec["base"])


def read_metadata(spark: SparkSession, path: str) -> dict:
    """Metadata of a saved model; missing or corrupt metadata gives ``{}``."""
    try:
        rows = spark.read.text(f"{path}/metadata").collect()
        return json.loads(rows[0][0]) if rows else {}
    except Exception:  # noqa: BLE001 - corrupt metadata is tolerated
        return {}


def find_model_dirs(spark: SparkSession, search_dir: str, patterns: Sequence[str] = MODEL_PATTERNS) -> list[str]:
    """Saved model folders by the ordered name patterns, on whatever store ``search_dir`` names; within a pattern in
    name order. Names that hold the word metadata are passed over."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for pattern in patterns:
        glob = jvm.org.apache.hadoop.fs.Path(f"{search_dir.rstrip('/')}/{pattern}/model")
        fs = glob.getFileSystem(conf)
        for status in fs.globStatus(glob) or []:
            folder = status.getPath().getParent()
            if METADATA_WORD not in folder.getName() and folder.toString() not in found:
                found.append(folder.toString())
    return found


def load_model(spark: SparkSession, search_dir: str, patterns: Sequence[str] = MODEL_PATTERNS,
               fallback: Callable | None = None):
    """First saved model by the ordered name patterns that can be read; returns ``(BoostedTrees, metadata)``.
    Without one, ``fallback()`` (e.g. a training function) is called, else None."""
    for path in find_model_dirs(spark, search_dir, patterns):
        try:
            return read_model(spark, path), read_metadata(spark, path)
        except Exception:  # noqa: BLE001 - an unreadable model is passed over, as a missing one
            continue
    return fallback() if fallback else None
