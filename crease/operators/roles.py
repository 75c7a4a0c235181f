"""Player archetypes: standardisation, k-means, centroid labels, modal cluster, primary role."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.expressions import zero
from crease.operators.kmeans import fit_centres, vector_number
from crease.schema import (
    ALLROUNDER, BATTER_CLUSTER_FEATURES, BOWLER_CLUSTER_FEATURES, SPECIALIST,
)


@dataclass
class ClusterResult:
    """Assigned rows (``cluster`` column), centroids in original units
    (``cluster`` + feature columns, at most k rows) and the feature list."""
    assigned: DataFrame
    centroids: DataFrame
    features: list[str]
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)


def standardise(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> tuple[DataFrame, list[float], list[float]]:
    """Zero mean, unit population variance; a constant column scales by 1 (-> 0).
    One aggregate; the 2·d moments reach the driver."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    mean = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
    std = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
    std = [s if s > 0 else 1.0 for s in std]
    out = df.withColumns({c + suffix: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                          for c, m, s in zip(cols, mean, std)})
    return out, mean, std


def _nearest(zcols: Sequence[str], centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid (squared Euclidean; ties -> lowest index). Each distance stands once in the
    expression: choices inside choices double it with every centroid."""
    dists = []
    for j, cen in enumerate(centroids):
        d = None
        for c, v in zip(zcols, cen):
            t = (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
            d = t if d is None else d + t
        dists.append(F.struct(d.alias("far"), F.lit(j).alias("cluster")))
    return F.least(*dists)["cluster"] if len(dists) > 1 else F.lit(0)


def _prepare(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: (zero(c) if c in df.columns else F.lit(0.0)) for c in features})


def _empty(d: DataFrame, features: list[str], out: str) -> ClusterResult:
    columns = ", ".join(["cluster int"] + [f"{c} double" for c in features])
    return ClusterResult(d.withColumn(out, F.lit(None).cast("long")), d.sparkSession.createDataFrame([], columns),
                         features)


def _result(d: DataFrame, zcols: list[str], centers: list[list[float]], features: list[str], mean: list[float],
            std: list[float], out: str) -> ClusterResult:
    assigned = kmeans_assign(d, zcols, centers, out).withColumn(out, F.col(out).cast("long")).drop(*zcols)
    raw = [(j, *[float(v) * s + m for v, s, m in zip(cen, std, mean)]) for j, cen in enumerate(centers)]
    cdf = d.sparkSession.createDataFrame(raw, ", ".join(["cluster int"] + [f"{c} double" for c in features]))
    return ClusterResult(assigned, cdf, features, mean, std)


def kmeans_assign(df: DataFrame, zcols: Sequence[str], centroids: list[list[float]], out: str = "cluster") -> DataFrame:
    """Nearest centroid per row; the k centroids are literals in the expression (no join)."""
    return df.withColumn(out, _nearest(zcols, centroids))


def kmeans_fit(df: DataFrame, features: Sequence[str], k: int = 4, restarts: int = 20, seed: int = 42,
               out: str = "cluster") -> ClusterResult:
    """k-means on standardised features, the best of ``restarts`` fits (``kmeans.fit_centres``), each taken to its fixed
    point; k = min(k, distinct rows). Clusters are numbered by centroid order. Empty input -> empty result, no fit."""
    features = list(features)
    d = _prepare(df, features)
    if d.isEmpty():
        return _empty(d, features, out)
    d, mean, std = standardise(d, features)
    zcols = [c + "_z" for c in features]
    centers, _ = fit_centres(d, zcols, vector_number([F.col(c) for c in features]), k, restarts, seed)
    return _result(d, zcols, centers, features, mean, std, out)


def kmeans_check(result: ClusterResult, out: str = "cluster") -> DataFrame:
    """``(cluster, misassigned, drift)``: rows of a cluster that lie nearer to another centroid, and the largest
    distance in any feature, in standard units, between the centroid and its members' mean. A fixed point has 0."""
    features = result.features
    d = result.assigned.withColumns({f"_z{i}": (zero(c) - m) / s for i, (c, m, s) in
                                     enumerate(zip(features, result.mean, result.std))})
    zcols = [f"_z{i}" for i in range(len(features))]
    rows = sorted((r["cluster"], [(r[c] - m) / s for c, m, s in zip(features, result.mean, result.std)])
                  for r in result.centroids.collect())  # at most k
    centers = [c for _, c in rows]
    near = kmeans_assign(d, zcols, centers, "_near")
    sums = near.groupBy(F.col(out).cast("int").alias("cluster")).agg(
        F.count_if(F.col("_near") != F.col(out)).alias("misassigned"), *[F.avg(c).alias(c) for c in zcols])
    def centre(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(c[i]) for c in centers]), F.col("cluster") + 1)
    drift = F.greatest(*[F.abs(F.col(c) - centre(i)) for i, c in enumerate(zcols)], F.lit(0.0))
    return sums.select("cluster", "misassigned", drift.alias("drift"))


def cluster_batters(batting: DataFrame, k: int = 4, **kw) -> ClusterResult:
    """Batter archetypes: the best of the restarts of ``kmeans_fit``."""
    return kmeans_fit(batting, BATTER_CLUSTER_FEATURES, k, out="batter_cluster", **kw)


def cluster_bowlers(bowling: DataFrame, k: int = 4, **kw) -> ClusterResult:
    """Bowler archetypes: the best of the restarts of ``kmeans_fit``."""
    return kmeans_fit(bowling, BOWLER_CLUSTER_FEATURES, k, out="bowler_cluster", **kw)


def _p(col: str, q: float) -> Column:
    return F.percentile(F.col(col), F.lit(q))


def label_batter_clusters(centroids: DataFrame) -> DataFrame:
    """SR >= p75 Power Hitter; dot% >= p75 Anchor; average >= p75 Accumulator;
    else Finisher (rules in order, labels may repeat). Percentiles over the k
    centroids (a k-row scalar subquery)."""
    q = centroids.agg(F.array(_p("batting_strike_rate", 0.75), _p("dot_percentage", 0.75),
                              _p("batting_average", 0.75))).scalar()
    label = F.when(F.col("batting_strike_rate") >= q[0], F.lit("Power Hitter")) \
        .when(F.col("dot_percentage") >= q[1], F.lit("Anchor")) \
        .when(F.col("batting_average") >= q[2], F.lit("Accumulator")).otherwise(F.lit("Finisher"))
    return centroids.select(F.col("cluster").cast("long").alias("cluster"), label.alias("label"))


def label_bowler_clusters(centroids: DataFrame) -> DataFrame:
    """efficacy >= p75 Death Specialist; wickets >= p75 Strike Bowler;
    economy <= p25 Powerplay Controller; else Middle Overs."""
    q = centroids.agg(F.array(_p("phase_efficacy", 0.75), _p("wickets_per_match", 0.75),
                              _p("bowling_economy", 0.25))).scalar()
    label = F.when(F.col("phase_efficacy") >= q[0], F.lit("Death Specialist")) \
        .when(F.col("wickets_per_match") >= q[1], F.lit("Strike Bowler")) \
        .when(F.col("bowling_economy") <= q[2], F.lit("Powerplay Controller")).otherwise(F.lit("Middle Overs"))
    return centroids.select(F.col("cluster").cast("long").alias("cluster"), label.alias("label"))


def role_label_map(df: DataFrame, labels: DataFrame, cluster_col: str, out: str) -> DataFrame:
    """Cluster id -> label (the label table has at most k rows: broadcast)."""
    t = F.broadcast(labels.select(F.col("cluster").alias(cluster_col), F.col("label").alias(out)))
    return df.join(t, cluster_col, "left")


def cluster_mode(assigned: DataFrame, cluster_col: str, key: str = "player") -> DataFrame:
    """Most frequent cluster per player, ties -> smallest id (bounded k-entry state per group)."""
    return assigned.filter(F.col(cluster_col).isNotNull()).groupBy(key).agg(
        F.mode(F.col(cluster_col), deterministic=True).alias(cluster_col))


def cluster_centroid_points(assigned: DataFrame, x: str, y: str, role_col: str) -> DataFrame:
    """Mean (x, y) per archetype label, for plot annotation."""
    return assigned.filter(F.col(role_col).isNotNull()).groupBy(role_col).agg(
        F.avg(x).alias(x), F.avg(y).alias(y))


def primary_role(balls_faced: str = "balls_faced", balls_bowled: str = "balls_bowled",
                 batter_role: str = "batter_role", bowler_role: str = "bowler_role",
                 bat_min: float = 30, bowl_min: float = 18) -> Column:
    """Allrounder when both workloads clear their thresholds; else the label of
    the role with workload; else any label; else Specialist."""
    has_bat = F.coalesce(F.col(balls_faced), F.lit(0)) > bat_min
    has_bowl = F.coalesce(F.col(balls_bowled), F.lit(0)) > bowl_min
    bat_l = F.nullif(F.col(batter_role), F.lit(""))
    bowl_l = F.nullif(F.col(bowler_role), F.lit(""))
    return F.when(has_bat & has_bowl, F.lit(ALLROUNDER)) \
        .when(has_bat & bat_l.isNotNull(), bat_l) \
        .when(has_bowl & bowl_l.isNotNull(), bowl_l) \
        .otherwise(F.coalesce(bat_l, bowl_l, F.lit(SPECIALIST)))
