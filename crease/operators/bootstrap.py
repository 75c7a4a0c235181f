"""Bootstrap confidence intervals with Poisson replicate weights, one vector of replicates per task.

Rows that agree in label, prediction and score(s) are interchangeable, so they are counted once, and a replicate draws
one weight per group: the sum of n independent Poisson(1) weights, which is Poisson(n). Groups of fewer than
``EXACT_ROWS`` rows add up Poisson(1) draws; for larger ones the distribution function of Poisson(n) is inverted. The
uniform numbers come from a portable integer hash of (group, replicate, draw, seed), so they are reproducible and the
same in any SQL engine.

No row is multiplied by its replicates. The groups are dealt by range of their score; a task reads its groups in order,
draws the weights of a block of groups for all replicates as one matrix, and keeps a vector of replicates per sum:

1. one scan gives, per range, the sums of the additive metrics and the positive and negative weights, and the part of the
   Mann-Whitney statistic that lies inside the range; what is left of it follows from the ranges' totals;
2. for average precision, which needs the weights above every score, a second scan starts from the ranges' offsets.

Metrics of one's own are aggregate expressions; for these alone the groups are expanded (``replicate_weights``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma
from typing import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.expressions import HASH_MOD
from crease.operators.metrics import LOG_LOSS_EPS, finish_point_metrics
from crease.operators.ordered import splitters, with_cell
from crease.session import ship_package
from crease.sources.sinks import scratch_path

# Cumulative distribution of Poisson(1), P(K <= k) for k = 0..9.
POISSON1_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238463,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745216,
]

#: Groups with fewer rows add up that many Poisson(1) draws; both ways are exact.
EXACT_ROWS = 64
#: Ranges of scores; the offsets of all ranges and replicates are broadcast (4 MB for 1,000 replicates).
RANGES = 256
#: Groups whose weights a task draws at a time.
BLOCK_GROUPS = 256
#: Scores are told apart by their whole part and this many parts of one.
SCORE_UNITS = 1 << 53
#: Multipliers of the two halves of a group's number, as (last, low, high, step, square's step).
NUMBER_HALVES = ((48271, 40692, 69621, 12345, 777), (39373, 16807, 45991, 54321, 4211))

ALL_METRICS = ("accuracy", "f1", "roc_auc", "pr_auc", "log_loss", "brier_score")
PROBABILISTIC = {"roc_auc", "pr_auc", "log_loss", "brier_score", "mae"}

#: A metric of one's own: (weight, y, prediction, score) -> an aggregate, such as
#: ``lambda w, y, h, p: F.sum(w * F.abs(y - p)) / F.sum(w)``.
MetricFunction = Callable[[Column, Column, Column, Column], Column]
Metrics = Sequence[str] | Mapping[str, MetricFunction]


# ---------------------------------------------------------------- groups and their numbers
def score_counts(df: DataFrame, y: str, yhat: Mapping[str, str | None], p: Mapping[str, str | None]) -> DataFrame:
    """``_y``, per model ``_h_<name>`` and ``_p_<name>``, the number of rows ``_rows`` and a number ``_group``."""
    def value(c: str | None) -> Column:
        return F.col(c).cast("double") if c else F.lit(None).cast("double")

    keys = {"_y": value(y)} | {f"_h_{m}": value(c) for m, c in yhat.items()} | {f"_p_{m}": value(c) for m, c in p.items()}
    counted = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("_rows"))
    return with_group_number(counted, [f"{kind}{m}" for m in p for kind in ("_p_", "_h_")] + ["_y"])


def with_group_number(groups: DataFrame, columns: Sequence[str], out: str = "_group") -> DataFrame:
    """``out``: 62 bits mixed from the values of numeric columns, nulls as 0; integer arithmetic any SQL engine has.

    Each step is a projection of its own, as it reads the one before it twice."""
    m = F.lit(HASH_MOD).cast("long")
    d = groups.withColumns({"_n0": F.lit(1).cast("long"), "_n1": F.lit(1).cast("long")})
    for c in columns:
        whole = F.floor(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        parts = ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - whole) * F.lit(float(SCORE_UNITS))).cast("long")
        for value in (whole.cast("long"), parts):
            d = d.withColumn("_value", value)
            d = d.withColumns({"_low": F.pmod("_value", m), "_high": F.pmod(
                F.call_function("div", F.col("_value") - F.pmod("_value", m), m), m)})
            d = d.withColumns({f"_n{i}": (F.col(f"_n{i}") * a + F.col("_low") * b + F.col("_high") * c2 + step) % m
                               for i, (a, b, c2, step, _) in enumerate(NUMBER_HALVES)})
            d = d.withColumns({f"_n{i}": (F.col(f"_n{i}") * F.col(f"_n{i}") + half[4]) % m
                               for i, half in enumerate(NUMBER_HALVES)})
    number = F.col("_n0") * F.lit(1 << 31).cast("long") + F.col("_n1")
    return d.withColumn(out, number).drop("_n0", "_n1", "_value", "_low", "_high")


def group_numbers(columns: Sequence[np.ndarray]) -> np.ndarray:
    """``with_group_number`` of arrays of doubles (NaN for null)."""
    halves = [np.ones(len(columns[0]), np.int64) for _ in NUMBER_HALVES]
    for column in columns:
        values = np.nan_to_num(column)
        whole = np.floor(values)
        for value in (whole.astype(np.int64), ((values - whole) * SCORE_UNITS).astype(np.int64)):
            low, high = value % HASH_MOD, (value // HASH_MOD) % HASH_MOD
            for i, (a, b, c, step, square) in enumerate(NUMBER_HALVES):
                mixed = (halves[i] * a + low * b + high * c + step) % HASH_MOD
                halves[i] = (mixed * mixed + square) % HASH_MOD
    return halves[0] * (1 << 31) + halves[1]


# ---------------------------------------------------------------- weights
def portable_uniform(numbers: np.ndarray, salts: np.ndarray, seed: int) -> np.ndarray:
    """``with_portable_uniform`` for every pair of a number and a salt: (numbers, salts) values in [0, 1)."""
    m = HASH_MOD
    low = (numbers % m)[:, None]
    x = (low * 48271 + (numbers // m)[:, None] * 40692 + salts[None, :] * 69621 + seed) % m
    x = (x * x + 12345) % m
    x = (x * 48271 + low) % m
    return ((x * x + 777) % m) / float(m)


def poisson_table(n: int) -> tuple[int, np.ndarray]:
    """(least value, P(K <= k) from it on) of Poisson(n), but for tails far under the resolution of the draws."""
    low, high = poisson_span(n)
    k = range(low, high + 1)
    return low, np.cumsum([np.exp(i * np.log(n) - n - lgamma(i + 1)) for i in k])


def poisson_span(n: int) -> tuple[int, int]:
    reach = int(10 * np.sqrt(n)) + 10
    return max(0, n - reach), n + reach


class Weights:
    """The replicate weights of groups; remembers the tables of large counts."""

    def __init__(self, n_boot: int, seed: int):
        self.replicates, self.seed = np.arange(n_boot, dtype=np.int64), seed
        self.tables: dict[int, tuple[int, np.ndarray]] = {}

    def draw(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(groups, replicates)."""
        out = np.zeros((len(numbers), len(self.replicates)))
        few = rows < EXACT_ROWS
        for nth in range(1, int(rows[few].max(initial=0)) + 1):
            at = np.flatnonzero(few & (rows >= nth))
            u = portable_uniform(numbers[at], self.replicates * EXACT_ROWS + nth, self.seed)
            out[at] += np.searchsorted(POISSON1_CDF, u, side="right")
        for at in np.flatnonzero(~few):
            n = int(rows[at])
            if n not in self.tables:
                if len(self.tables) > 1_000:
                    self.tables.clear()
                self.tables[n] = poisson_table(n)
            low, table = self.tables[n]
            u = portable_uniform(numbers[at:at + 1], self.replicates * EXACT_ROWS, self.seed)[0]
            out[at] = low + np.searchsorted(table, u, side="right")
        return out


def replicate_weights(groups: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """``groups`` once per replicate with the weight ``w`` drawn for it, for aggregate expressions of one's own."""
    ship_package(groups.sparkSession)
    values = [c for c in groups.columns if c not in ("_rows", "_group")]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(n_boot, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_GROUPS):
                part = batch.slice(at, BLOCK_GROUPS)
                drawn = weights.draw(part["_group"].to_numpy(), part["_rows"].to_numpy())
                again = pa.array(np.repeat(np.arange(part.num_rows), n_boot))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c].take(again) for c in values), pa.array(np.tile(np.arange(n_boot), part.num_rows)),
                     pa.array(drawn.ravel())], names=[*values, "replicate", "w"])

    # the table of groups may be small, but its expansion is not
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*(f"{c} double" for c in values), "replicate long", "w double"])
    return groups.repartition(parts, "_group").mapInArrow(expand, schema)


# ---------------------------------------------------------------- sums by range
SUMS = ["_n", "_pos", "_correct", "_tp", "_fp", "_fn", "_sq", "_ll", "_ae", "_u"]


def ranged_groups(groups: DataFrame, name: str) -> DataFrame:
    """Groups (a written table) with their model's label, prediction and score as ``y, h, p``, dealt and sorted by the
    range ``part`` of the score."""
    d = groups.select(F.col("_y").alias("y"), F.col(f"_h_{name}").alias("h"), F.col(f"_p_{name}").alias("p"), "_rows",
                      "_group")
    d = with_cell(d, "p", splitters(d, "p", RANGES), "part", RANGES)
    # a number is given, as adaptive execution would see a small table and put it into one task
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "part").sortWithinPartitions("part", "p")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict[str, np.ndarray]]]]:
    """Blocks of rows of each part; every part's must be read before the next."""
    def blocks() -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        for batch in batches:
            columns = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
            part = columns["part"]
            starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for start, end in zip(starts, starts[1:]):
                for at in range(start, end, BLOCK_GROUPS):
                    cut = slice(at, min(at + BLOCK_GROUPS, end))
                    yield int(part[at]), {c: v[cut] for c, v in columns.items()}

    waiting = None
    source = blocks()
    while True:
        first = waiting or next(source, None)
        if first is None:
            return
        waiting = None

        def of_part() -> Iterator[dict[str, np.ndarray]]:
            nonlocal waiting
            yield first[1]
            for number, block in source:
                if number != first[0]:
                    waiting = (number, block)
                    return
                yield block

        yield first[0], of_part()


class _Runs:
    """Positive and negative weights by distinct score, of blocks in the order of scores."""

    def __init__(self) -> None:
        self.score, self.held = None, None  # the last score of a block may go on in the next

    def add(self, p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
        if self.held is not None:
            if p[0] == self.score:
                pos[0] += self.held[0]
                neg[0] += self.held[1]
            else:
                pos, neg = np.concatenate([self.held[0][None], pos]), np.concatenate([self.held[1][None], neg])
        self.score, self.held = p[-1], (pos[-1], neg[-1])
        return (pos[:-1], neg[:-1]) if len(pos) > 1 else None

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        return None if self.held is None else (self.held[0][None], self.held[1][None])


def _score_runs(blocks: Iterator[dict[str, np.ndarray]], weights: Weights,
                also: Callable[[dict[str, np.ndarray], np.ndarray], None] = lambda block, w: None
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    runs = _Runs()
    for block in blocks:
        w = weights.draw(block["_group"], block["_rows"])
        also(block, w)
        scored = ~(np.isnan(block["p"]) | np.isnan(block["y"]))
        if scored.any():
            y, w = block["y"][scored], w[scored]
            done = runs.add(block["p"][scored], w * y[:, None], w * (1 - y)[:, None])
            if done:
                yield done
    if (done := runs.rest()) is not None:
        yield done


def range_sums(ranged: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``part, replicate`` and the ``SUMS``: of weights and additive metrics, and the Mann-Whitney statistic inside."""
    ship_package(ranged.sparkSession)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(n_boot, seed)
        for part, blocks in _by_part(batches):
            sums = {c: np.zeros(n_boot) for c in SUMS}

            def additive(block: dict[str, np.ndarray], w: np.ndarray) -> None:
                y, h, p = block["y"], block["h"], block["p"]
                clipped = np.clip(p, LOG_LOSS_EPS, 1 - LOG_LOSS_EPS)
                terms = {"_n": np.ones(len(y)), "_pos": y, "_correct": y == h, "_tp": y * h, "_fp": (1 - y) * h,
                         "_fn": y * (1 - h), "_sq": (p - y) ** 2,
                         "_ll": -(y * np.log(clipped) + (1 - y) * np.log(1 - clipped)), "_ae": np.abs(y - p)}
                total = np.nan_to_num(np.stack(list(terms.values())).astype(float)) @ w
                for c, vector in zip(terms, total):
                    sums[c] += vector

            below = np.zeros(n_boot)
            for pos, neg in _score_runs(blocks, weights, additive):
                before = below + np.cumsum(neg, axis=0) - neg
                sums["_u"] += (pos * (before + 0.5 * neg)).sum(axis=0)
                below = below + neg.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_boot, part)), pa.array(np.arange(n_boot)),
                                              *(pa.array(sums[c]) for c in SUMS)], names=["part", "replicate", *SUMS])

    return ranged.mapInArrow(add_up, "part long, replicate long, " + ", ".join(f"{c} double" for c in SUMS))


def precision_sums(ranged: DataFrame, sums: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``replicate, pr_auc``: the sum over scores of positive weight times precision, from each range's offsets."""
    pos, neg = np.zeros((RANGES, n_boot)), np.zeros((RANGES, n_boot))
    in_order = F.array_sort(F.collect_list(F.struct("replicate", "_n", "_pos")))
    for row in sums.groupBy("part").agg(in_order.alias("r")).select("part", "r._n", "r._pos").collect():
        pos[row.part] = row["_pos"]
        neg[row.part] = np.array(row["_n"]) - pos[row.part]
    # weights at or above the first score of each range, and all positive weights
    above = np.cumsum(pos[::-1], axis=0)[::-1], np.cumsum(neg[::-1], axis=0)[::-1]
    source = ranged.sparkSession.sparkContext.broadcast(above)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(n_boot, seed)
        for part, blocks in _by_part(batches):
            tp, fp = (half[part].copy() for half in source.value)
            total = np.zeros(n_boot)
            for pos, neg in _score_runs(blocks, weights):
                at_tp, at_fp = tp - (np.cumsum(pos, axis=0) - pos), fp - (np.cumsum(neg, axis=0) - neg)
                total += np.where(pos > 0, pos * at_tp / np.maximum(at_tp + at_fp, 1e-300), 0.0).sum(axis=0)
                tp, fp = tp - pos.sum(axis=0), fp - neg.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), pa.array(total), pa.array(source.value[0][0])],
                                             names=["replicate", "s", "p"])

    found = ranged.mapInArrow(add_up, "replicate long, s double, p double")
    return found.groupBy("replicate").agg(F.sum("s").alias("s"), F.max("p").alias("p")).select(
        "replicate", F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("pr_auc"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replicate_metrics(groups: DataFrame, name: str, yhat: str | None, p: str | None, metrics: Metrics,
                      n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """The metrics of one model per ``replicate``, as ``<name>:<metric>``; replicates with one class only are left out.
    ``groups`` is a written table."""
    if isinstance(metrics, Mapping):
        w, yv = F.col("w"), F.col("_y")
        aggs = [f(w, yv, F.col(f"_h_{name}"), F.col(f"_p_{name}")).alias(f"{name}:{m}") for m, f in metrics.items()]
        share = F.sum(w * yv) / F.sum(w)
        return replicate_weights(groups, n_boot, seed).groupBy("replicate").agg(*aggs, share.alias("_share")) \
            .filter((F.col("_share") > 0) & (F.col("_share") < 1)).drop("_share")
    ranged = ranged_groups(groups, name)
    sums = _stored(range_sums(ranged, n_boot, seed), "replicates")
    needed = ["_n", "_pos", *(["_correct", "_tp", "_fp", "_fn"] if yhat else []), *(["_sq", "_ll", "_ae"] if p else [])]
    point = finish_point_metrics(sums.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in needed)), ["replicate"]) \
        .filter((F.col("positive_rate") > 0) & (F.col("positive_rate") < 1))
    out = point.select("replicate", *[F.col(c).alias(f"{name}:{c}") for c in metrics if c in point.columns])
    if p and "roc_auc" in metrics:
        before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        negative = F.col("_n") - F.col("_pos")
        whole = sums.withColumn("_below", F.coalesce(F.sum(negative).over(before), F.lit(0.0))).groupBy("replicate").agg(
            (F.sum(F.col("_u") + F.col("_pos") * F.col("_below")) / (F.sum("_pos") * F.sum(negative)))
            .alias(f"{name}:roc_auc"))
        out = out.join(whole, "replicate", "left")
    if p and "pr_auc" in metrics:
        out = out.join(precision_sums(ranged, sums, n_boot, seed).withColumnRenamed("pr_auc", f"{name}:pr_auc"),
                       "replicate", "left")
    return out


def _long(table: DataFrame, names: Sequence[str], value: Callable[[str], Column]) -> DataFrame:
    return table.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), value(m).cast("double").alias("value")) for m in names])).alias("m")) \
        .select("m.metric", "m.value")


def _ci(long: DataFrame, confidence: float, keys: Sequence[str]) -> DataFrame:
    alpha = 1 - confidence
    return long.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.percentile("value", F.lit(alpha / 2)).alias("ci_lower"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("ci_upper"),
        F.count(F.lit(1)).alias("n_valid"))


def _full_sample(df: DataFrame, y: str, yhat: str | None, p: str | None, metrics: Metrics) -> DataFrame:
    """One row: the metrics over all rows and ``positive_rate``."""
    from crease.operators.metrics import binary_metrics, point_metrics
    if isinstance(metrics, Mapping):
        one, yv = F.lit(1.0), F.col(y).cast("double")
        h, s = (F.col(c).cast("double") if c else F.lit(None).cast("double") for c in (yhat, p))
        return df.agg(*[f(one, yv, h, s).alias(m) for m, f in metrics.items()], F.avg(yv).alias("positive_rate"))
    if p and ({"roc_auc", "pr_auc"} & set(metrics)):
        return binary_metrics(df, y, yhat, p)
    return point_metrics(df, y, yhat, p)


def bootstrap_metrics(df: DataFrame, y: str = "y_true", yhat: str | None = "y_pred", p: str | None = "y_pred_proba",
                      metrics: Metrics = ALL_METRICS, n_boot: int = 1000, confidence: float = 0.95,
                      seed: int = 42) -> DataFrame:
    """``(metric, value, ci_lower, ci_upper)``: full-sample value and percentile CI.

    ``metrics`` names built-in ones or maps names to functions of one's own.
    Replicates drawing a single class are skipped; with none left the interval
    collapses to the value. Probabilistic metrics are null when the labels hold
    one class."""
    names = list(metrics)
    full = _full_sample(df, y, yhat, p, metrics)
    full_long = full.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("m"),
        F.col("positive_rate")).select("m.metric", "m.value", "positive_rate")
    groups = _stored(score_counts(df, y, {"m": yhat}, {"m": p}), "groups")
    reps = replicate_metrics(groups, "m", yhat, p, metrics, n_boot, seed)
    ci = _ci(_long(reps, names, lambda m: F.col(f"`m:{m}`")), confidence, ["metric"])
    j = full_long.join(ci, "metric", "left")
    single = (F.col("positive_rate") <= 0) | (F.col("positive_rate") >= 1)
    degenerate = F.col("metric").isin(*PROBABILISTIC) & single
    value = F.when(degenerate, F.lit(None).cast("double")).otherwise(F.col("value"))
    return j.select("metric", value.alias("value"),
                    F.when(degenerate, None).otherwise(F.coalesce("ci_lower", "value")).alias("ci_lower"),
                    F.when(degenerate, None).otherwise(F.coalesce("ci_upper", "value")).alias("ci_upper"))


def paired_bootstrap_delta(df: DataFrame, y: str, p_model: str, p_base: str, metric: str | MetricFunction = "roc_auc",
                           n_boot: int = 1000, confidence: float = 0.95, seed: int = 42,
                           yhat_threshold: float = 0.5) -> DataFrame:
    """Model minus baseline on the same replicate weights: ``(metric, delta, ci_lower, ci_upper)``.

    Rows are grouped by both scores, so both models see the same weights."""
    name = metric if isinstance(metric, str) else getattr(metric, "__name__", "metric")
    metrics: Metrics = [metric] if isinstance(metric, str) else {name: metric}
    d = df.withColumns({"_hm": (F.col(p_model) >= yhat_threshold).cast("int"),
                        "_hb": (F.col(p_base) >= yhat_threshold).cast("int")})
    models = {"m": ("_hm", p_model), "b": ("_hb", p_base)}
    full = {m: _full_sample(d, y, h, p, metrics).select(F.col(name).alias(m)) for m, (h, p) in models.items()}
    delta = full["m"].select(F.lit(name).alias("metric"), (F.col("m") - full["b"].scalar()).alias("delta"))
    groups = score_counts(d, y, {m: h for m, (h, _) in models.items()}, {m: p for m, (_, p) in models.items()})
    groups = _stored(groups, "groups")
    reps = [replicate_metrics(groups, m, h, p, metrics, n_boot, seed) for m, (h, p) in models.items()]
    both = reps[0].join(reps[1], "replicate", "inner")
    long = _long(both, [name], lambda m: F.col(f"`m:{m}`") - F.col(f"`b:{m}`"))
    return delta.join(_ci(long, confidence, ["metric"]), "metric", "left").select(
        "metric", "delta", F.coalesce("ci_lower", "delta").alias("ci_lower"),
        F.coalesce("ci_upper", "delta").alias("ci_upper"))
