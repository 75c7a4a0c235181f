"""Binary classification metrics as distributed aggregates.

Every metric accepts an optional ``weight`` column (bootstrap replicates) and
``partition_cols`` (slices, replicates): one aggregate computes them for all
groups at once. Rank metrics (ROC AUC, average precision, curves) first group
by distinct score, then use prefix sums over cells cut at a sample of the
distinct scores (``ordered.prefix_sums``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.operators.ordered import prefix_sums, splitters

# Fixed value: double-precision epsilon, to which probabilities are clipped before the logarithm.
LOG_LOSS_EPS = 2.220446049250313e-16


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def point_metric_aggs(y: str, yhat: str | None, p: str | None, weight: str | None = None) -> list[Column]:
    """Aggregates for accuracy, precision/recall/f1 pieces, brier, log loss, MAE, counts."""
    w = _w(weight)
    yv = F.col(y).cast("double")
    aggs = [F.sum(w).alias("_n"), F.sum(w * yv).alias("_pos")]
    if yhat:
        yh = F.col(yhat).cast("double")
        aggs += [F.sum(w * (yv == yh).cast("double")).alias("_correct"),
                 F.sum(w * yv * yh).alias("_tp"), F.sum(w * (1 - yv) * yh).alias("_fp"),
                 F.sum(w * yv * (1 - yh)).alias("_fn")]
    if p:
        pv = F.col(p).cast("double")
        pc = F.least(F.greatest(pv, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
        aggs += [F.sum(w * (pv - yv) * (pv - yv)).alias("_sq"),
                 F.sum(w * -(yv * F.log(pc) + (1 - yv) * F.log(1 - pc))).alias("_ll"),
                 F.sum(w * F.abs(yv - pv)).alias("_ae")]
    return aggs


def finish_point_metrics(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Turn the partial sums of ``point_metric_aggs`` into metric columns."""
    cols = set(df.columns)
    n, pos = F.col("_n"), F.col("_pos")
    two_class = (pos > 0) & (pos < n)
    out = {"n_samples": n, "positive_rate": pos / n}
    if "_correct" in cols:
        tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
        out["accuracy"] = F.col("_correct") / n
        out["precision"] = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        out["recall"] = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        out["f1"] = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    if "_sq" in cols:
        out["brier_score"] = F.col("_sq") / n
        out["log_loss"] = F.when(two_class, F.col("_ll") / n)
        out["mae"] = F.col("_ae") / n
    return df.select(*keep, *[v.alias(k) for k, v in out.items()])


def point_metrics(df: DataFrame, y: str = "y_true", yhat: str | None = "y_pred", p: str | None = "y_pred_proba",
                  partition_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1, brier, log loss (two classes only), MAE, n, positive rate."""
    part = list(partition_cols)
    agg = df.groupBy(*part).agg(*point_metric_aggs(y, yhat, p, weight))
    return finish_point_metrics(agg, part)


def score_groups(df: DataFrame, y: str, p: str, partition_cols: Sequence[str] = (),
                 weight: str | None = None) -> DataFrame:
    """(partition..., score, pos, neg) — one row per distinct score."""
    w = _w(weight)
    yv = F.col(y).cast("double")
    return df.groupBy(*partition_cols, F.col(p).cast("double").alias("score")).agg(
        F.sum(w * yv).alias("pos"), F.sum(w * (1 - yv)).alias("neg"))


def _splits(df: DataFrame, p: str) -> Column:
    return splitters(df.select(F.col(p).cast("double").alias("score")), "score")


def roc_auc(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", partition_cols: Sequence[str] = (),
            weight: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney ROC AUC with ties counted half; one class -> null."""
    part = list(partition_cols)
    g = groups if groups is not None else score_groups(df, y, p, part, weight)
    c = prefix_sums(g, "score", ["neg"], part, inclusive=False, splits=_splits(df, p))
    a = c.groupBy(*part).agg(F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))).alias("_u"),
                             F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return a.select(*part, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                  F.col("_u") / (F.col("_P") * F.col("_N"))).alias("roc_auc"))


def pr_auc(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", partition_cols: Sequence[str] = (),
           weight: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Average precision: Σ over distinct thresholds of ΔRecall · Precision; one class -> null."""
    part = list(partition_cols)
    g = groups if groups is not None else score_groups(df, y, p, part, weight)
    c = prefix_sums(g, "score", ["pos", "neg"], part, descending=True, inclusive=True, splits=_splits(df, p))
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    a = c.groupBy(*part).agg(F.sum(F.when(F.col("pos") > 0, F.col("pos") * prec).otherwise(F.lit(0.0))).alias("_s"),
                             F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return a.select(*part, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_s") / F.col("_P")).alias("pr_auc"))


def curve_points(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba",
                 partition_cols: Sequence[str] = ()) -> DataFrame:
    """Per distinct threshold (descending): tp, fp, fpr, tpr, precision, recall."""
    part = list(partition_cols)
    g = score_groups(df, y, p, part)
    c = prefix_sums(g, "score", ["pos", "neg"], part, descending=True, inclusive=True, splits=_splits(df, p))
    tot = g.groupBy(*part).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    c = c.join(tot, part, "inner") if part else \
        c.withColumns({"_P": tot.select("_P").scalar(), "_N": tot.select("_N").scalar()})
    return c.select(*part, F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"),
                    F.col("cum_neg").alias("fp"),
                    F.when(F.col("_N") > 0, F.col("cum_neg") / F.col("_N")).alias("fpr"),
                    F.when(F.col("_P") > 0, F.col("cum_pos") / F.col("_P")).alias("tpr"),
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    F.when(F.col("_P") > 0, F.col("cum_pos") / F.col("_P")).alias("recall"))


def roc_points(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba") -> DataFrame:
    return curve_points(df, y, p).select("threshold", "fpr", "tpr")


def pr_points(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba") -> DataFrame:
    return curve_points(df, y, p).select("threshold", "precision", "recall")


def binary_metrics(df: DataFrame, y: str = "y_true", yhat: str = "y_pred", p: str = "y_pred_proba",
                   partition_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """All point metrics plus ROC AUC and average precision per partition."""
    part = list(partition_cols)
    pm = point_metrics(df, y, yhat, p, part, weight)
    g = score_groups(df, y, p, part, weight)
    auc = roc_auc(df, y, p, part, weight, groups=g)
    ap = pr_auc(df, y, p, part, weight, groups=g)
    if not part:
        return pm.withColumns({"roc_auc": auc.scalar(), "pr_auc": ap.scalar()})
    return pm.join(auc, part, "left").join(ap, part, "left")


def classification_report(df: DataFrame, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """precision / recall / f1 / support per class, then accuracy, macro and weighted
    averages, as a long table ``(label, precision, recall, f1, support)``."""
    conf = df.groupBy(F.col(y).cast("int").alias("_y"), F.col(yhat).cast("int").alias("_h")).count()
    rows = []
    for cls in (0, 1):
        tp = F.sum(F.when((F.col("_y") == cls) & (F.col("_h") == cls), F.col("count")).otherwise(0))
        pred = F.sum(F.when(F.col("_h") == cls, F.col("count")).otherwise(0))
        sup = F.sum(F.when(F.col("_y") == cls, F.col("count")).otherwise(0))
        rows += [tp.alias(f"tp{cls}"), pred.alias(f"pred{cls}"), sup.alias(f"sup{cls}")]
    a = conf.agg(*rows, F.sum("count").alias("n"))

    def prf(cls):
        tp, pred, sup = F.col(f"tp{cls}"), F.col(f"pred{cls}"), F.col(f"sup{cls}")
        prec = F.when(pred > 0, tp / pred).otherwise(F.lit(0.0))
        rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        return prec, rec, f1, sup

    p0, r0, f0, s0 = prf(0)
    p1, r1, f1, s1 = prf(1)
    n = F.col("n")
    acc = (F.col("tp0") + F.col("tp1")) / n
    entries = [
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"),
                 s0.cast("long").alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"),
                 s1.cast("long").alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1"), n.cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f0 * s0 + f1 * s1) / n).alias("f1"),
                 n.cast("long").alias("support")),
    ]
    single = (F.col("sup0") == 0) | (F.col("sup1") == 0)
    out = a.select(single.alias("_single"), F.explode(F.array(*entries)).alias("e"))
    return out.select("e.label", "e.precision", "e.recall", "e.f1", "e.support",
                      F.when(F.col("_single"), F.lit("only one class present in y_true")).alias("note"))


def precision_at_k_upsets(df: DataFrame, y: str = "y_true", p: str = "y_pred_proba", k: int = 20,
                          threshold: float = 0.40, tiebreak: Sequence[str] = ("rid",)) -> DataFrame:
    """Among the ``k`` lowest predicted probabilities, the share that were
    predicted upsets (p < threshold) and won. Top-k via TakeOrderedAndProject."""
    tb = [F.col(c).asc() for c in tiebreak if c in df.columns]
    top = df.orderBy(F.col(p).asc(), *tb).limit(k)
    return top.agg((F.sum(((F.col(p) < threshold) & (F.col(y) == 1)).cast("double")) / F.lit(float(k)))
                   .alias("precision_at_k"), F.count(F.lit(1)).alias("k_rows"))
