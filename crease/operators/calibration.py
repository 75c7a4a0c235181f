"""Probability calibration: Platt, isotonic, reliability curve and ECE."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.operators.isotonic import isotonic_apply, isotonic_fit
from crease.operators.ordered import exact_quantiles, span

METHODS = ("platt", "isotonic")


def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"calibration knows the methods {', '.join(METHODS)}, not {method!r}")


def uniform_edges(n_bins: int) -> list[float]:
    """Inner bin edges ``i * (1 / n_bins)`` (the grid numpy's linspace produces)."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def bin_index(p: str, edges) -> Column:
    """Number of inner edges strictly below p: bins are right-closed inside [0, 1]."""
    if isinstance(edges, tuple):  # (array column, length): e.g. a scalar subquery
        arr, n = edges
        expr = F.lit(0)
        for i in range(n):
            expr = expr + (F.col(p) > arr[i]).cast("int")
        return expr
    expr = F.lit(0)
    for e in edges:
        expr = expr + (F.col(p) > F.lit(float(e))).cast("int")
    return expr


def calibration_bins(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", n_bins: int = 10,
                     strategy: str = "uniform", partition_cols: Sequence[str] = ()) -> DataFrame:
    """Per non-empty bin: n, fraction of positives, mean predicted value."""
    part = list(partition_cols)
    if strategy == "uniform":
        b = bin_index(p, uniform_edges(n_bins))
    elif strategy == "quantile":
        probs = [i / n_bins for i in range(n_bins + 1)]
        q = exact_quantiles(df, p, probs)
        edges = q.filter((F.col("q_index") > 0) & (F.col("q_index") < n_bins)) \
            .agg(F.array_sort(F.collect_list("value"))).scalar()
        b = bin_index(p, (edges, n_bins - 1))
    else:
        raise ValueError(f"bins are uniform or quantile, not {strategy!r}")
    return (df.groupBy(*part, b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("fraction_of_positives"),
                 F.avg(F.col(p).cast("double")).alias("mean_predicted_value")))


def calibration_curve(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", n_bins: int = 10,
                      strategy: str = "uniform") -> DataFrame:
    return calibration_bins(df, y, p, n_bins, strategy).select("bin", "fraction_of_positives",
                                                               "mean_predicted_value")


def expected_calibration_error(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", n_bins: int = 10,
                               partition_cols: Sequence[str] = ()) -> DataFrame:
    """Σ_b n_b / N · |fraction_b − mean_b| over the uniform bins (standard ECE, quirk Q9)."""
    part = list(partition_cols)
    bins = calibration_bins(df, y, p, n_bins, "uniform", part)
    return bins.groupBy(*part).agg(
        (F.sum(F.col("n") * F.abs(F.col("fraction_of_positives") - F.col("mean_predicted_value")))
         / F.sum("n")).alias("ece"))


def probability_histogram(df: DataFrame, p: str = "y_pred_proba", n_bins: int = 10) -> DataFrame:
    """Density histogram of ``n_bins`` equal bins from the smallest to the largest value (the last bin is closed,
    empty bins are there with count 0); a constant column gets the bins of [value - 0.5, value + 0.5]."""
    v = F.col(p).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v))
    bounds = span(rows, p)
    wide = bounds[1] > bounds[0]
    lo = F.when(wide, bounds[0]).otherwise(bounds[0] - 0.5)
    hi = F.when(wide, bounds[1]).otherwise(bounds[1] + 0.5)
    width = (hi - lo) / F.lit(float(n_bins))
    place = F.least(F.lit(n_bins - 1), F.floor((v - lo) / width).cast("int"))
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), n.cast("long").alias("count"),
        (n / (total * width)).alias("density"))


@dataclass
class PlattCalibrator:
    a: float
    b: float

    def column(self, p: str) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.a) * F.col(p) + F.lit(self.b))))


def platt_fit(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", max_iter: int = 1000) -> PlattCalibrator:
    """L2 logistic regression on the score, equivalent to C = 1: regParam = 1/n,
    unstandardised, intercept unpenalised. Two coefficients reach the driver."""
    n = df.count()
    vec = VectorAssembler(inputCols=[p], outputCol="_pv").transform(df.select(F.col(p).cast("double").alias(p),
                                                                              F.col(y).cast("double").alias("_y")))
    lr = LogisticRegression(featuresCol="_pv", labelCol="_y", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-10)
    m = lr.fit(vec)
    return PlattCalibrator(float(m.coefficients[0]), float(m.intercept))


def platt_gradient(df: DataFrame, cal: PlattCalibrator, y: str = "y_true", p: str = "y_pred_proba") -> DataFrame:
    """``(coefficient, gradient)`` of the penalised mean log loss at the calibrator: all 0 at the fit."""
    v = F.col(p).cast("double")
    error = cal.column(p) - F.col(y).cast("double")
    return df.agg(F.array(
        F.struct(F.lit("a").alias("coefficient"),
                 (F.avg(error * v) + F.lit(cal.a) / F.count(F.lit(1))).alias("gradient")),
        F.struct(F.lit("b").alias("coefficient"), F.avg(error).alias("gradient"))).alias("g")).select(F.inline("g"))


def platt_apply(df: DataFrame, cal: PlattCalibrator, p: str = "y_pred_proba",
                out: str = "y_pred_calibrated") -> DataFrame:
    return df.withColumn(out, cal.column(p))


def fit_calibrator(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", method: str = "platt"):
    _check_method(method)
    return platt_fit(df, y, p) if method == "platt" else isotonic_fit(df, y, p)


def apply_calibrator(df: DataFrame, calibrator, p: str = "y_pred_proba", method: str = "platt",
                     out: str = "y_pred_calibrated") -> DataFrame:
    _check_method(method)
    if method == "platt":
        return platt_apply(df, calibrator, p, out)
    return isotonic_apply(df, calibrator, p, out)


def calibrate_model(val: DataFrame | None, test: DataFrame, y: str = "y_true", p: str = "y_pred_proba",
                    method: str = "platt", out: str = "y_pred_calibrated") -> DataFrame:
    """Fit on validation predictions, apply to test; no validation -> unchanged."""
    _check_method(method)
    if val is None or val.isEmpty():
        return test.withColumn(out, F.col(p))
    return apply_calibrator(test, fit_calibrator(val, y, p, method), p, method, out)
