"""Reference forecasters: venue prior, recent team form, small logistic model."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.expressions import zero
from crease.operators.metrics import binary_metrics

EXCLUDED = {"match_id", "season", "team_won"}

# The features of the logistic baseline, those of them that the input has.
LOGISTIC_FEATURES = [
    "batting_strike_rate", "batting_average", "bowling_economy", "bowling_strike_rate", "batting_index",
    "bowling_index",
]


@dataclass
class PriorTable:
    """Per-key prior probabilities plus the global prior (a one-value subquery)."""
    table: DataFrame | None
    key: str | None
    global_prior: Column

    def predict(self, df: DataFrame, out: str = "p_baseline") -> DataFrame:
        if self.table is None or self.key not in df.columns:
            return df.withColumn(out, self.global_prior)
        t = self.table.select(self.key, F.col("prior").alias("_prior"))
        return df.join(t, self.key, "left").withColumn(out, F.coalesce("_prior", self.global_prior)).drop("_prior")


def venue_baseline(train: DataFrame, y: str = "y_true", venue: str = "venue") -> PriorTable:
    """Win rate per venue; unseen venues and a missing venue column get the global rate."""
    g = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    if venue not in train.columns:
        return PriorTable(None, None, g)
    t = train.filter(F.col(venue).isNotNull()).groupBy(venue).agg(
        F.avg(F.col(y).cast("double")).alias("prior"), F.count(F.lit(1)).alias("n"))
    return PriorTable(t, venue, g)


def venue_prior_lookup(df: DataFrame, priors: PriorTable, out: str = "p_baseline") -> DataFrame:
    return priors.predict(df, out)


def recent_form(train: DataFrame, y: str = "y_true", team: str = "team", window: int = 5,
                order: Sequence[str] = ("date", "match_id", "rid")) -> DataFrame:
    """Mean of each team's last ``window`` outcomes in training order (fewer -> all).

    ``row_number() <= window`` over a per-team window lets Spark insert a
    group-limit before the shuffle, so a team with a huge history only sends
    ``window`` rows per task (quirk Q17: rows, not matches, are counted)."""
    keys = [c for c in order if c in train.columns]
    w = Window.partitionBy(team).orderBy(*[F.col(c).desc() for c in keys])
    last = train.filter(F.col(team).isNotNull()).withColumn("_rn", F.row_number().over(w)) \
        .filter(F.col("_rn") <= window)
    return last.groupBy(team).agg(F.avg(F.col(y).cast("double")).alias("prior"),
                                  F.count(F.lit(1)).alias("n"))


def recent_form_baseline(train: DataFrame, y: str = "y_true", team: str = "team", window: int = 5,
                         order: Sequence[str] = ("date", "match_id", "rid")) -> PriorTable:
    g = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    if team not in train.columns:
        return PriorTable(None, None, g)
    return PriorTable(recent_form(train, y, team, window, order), team, g)


@dataclass
class LinearScorer:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for c, w in zip(self.features, self.coefficients):
            z = z + zero(c) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logistic_features(df: DataFrame, y: str, features: Sequence[str] | None = None) -> list[str]:
    """The given features, or the fixed list, or else every numeric column but ids, season and target."""
    wanted = list(features) if features else LOGISTIC_FEATURES
    found = [c for c in wanted if c in df.columns]
    if found:
        return found
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")
            and c not in EXCLUDED and c != y]


def logistic_baseline(train: DataFrame, y: str = "y_true", features: Sequence[str] | None = None,
                      max_iter: int = 1000, tol: float = 1e-12) -> LinearScorer:
    """L2 logistic regression (C = 1 equivalent) on all of ``logistic_features``."""
    cols = logistic_features(train, y, features)
    if not cols:
        raise ValueError("the logistic baseline found no numeric column to learn from")
    n = train.count()
    d = train.select(*[zero(c).alias(c) for c in cols], F.col(y).cast("double").alias("_y"))
    d = VectorAssembler(inputCols=cols, outputCol="_x").transform(d)
    m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                           standardization=False, maxIter=max_iter, tol=tol).fit(d)
    return LinearScorer(cols, [float(v) for v in m.coefficients], float(m.intercept))


def logistic_score(df: DataFrame, scorer: LinearScorer, out: str = "p_baseline") -> DataFrame:
    return df.withColumn(out, scorer.column())


def logistic_gradient(df: DataFrame, scorer: LinearScorer, y: str) -> DataFrame:
    """``(coefficient, gradient)`` of the penalised mean log loss at the scorer's coefficients: all 0 at the fit."""
    error = scorer.column() - F.col(y).cast("double")
    parts = [F.struct(F.lit(c).alias("coefficient"),
                      (F.avg(error * zero(c)) + F.lit(w) / F.count(F.lit(1))).alias("gradient"))
             for c, w in zip(scorer.features, scorer.coefficients)]
    parts.append(F.struct(F.lit("intercept").alias("coefficient"), F.avg(error).alias("gradient")))
    return df.agg(F.array(*parts).alias("g")).select(F.inline("g"))


def evaluate_baseline(pred: DataFrame, y: str = "y_true", p: str = "p_baseline") -> DataFrame:
    """Accuracy at 0.5, plus ROC AUC and log loss when both classes occur."""
    d = pred.withColumn("_yhat", (F.col(p) >= 0.5).cast("int"))
    m = binary_metrics(d, y, "_yhat", p)
    return m.select("accuracy", "roc_auc", "log_loss", "n_samples")
