"""Order-dependent aggregates without a global single-partition window.

A ``Window.orderBy`` with no partition moves every row to one task. Here the
values are cut into cells of about equal numbers of distinct values; the totals
of the cells give each cell an offset, and the running sum inside a cell is an
ordinary partitioned window. Where the cells are cut is read off a sample of the
distinct values, those with the smallest hashes (``splitters``), so values that
crowd into a small part of a wide range, or texts that begin alike, are spread
over all cells as any others are. Where values are known to be spread evenly
(``bounds``), cells of equal width do. Everything is lazy: the sample, or the
range, is a scalar subquery.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most cells; a power of two.
CELLS = 4096
#: Rows a task numbers, and at most; wide ones take about 500 bytes each.
NUMBERED_OF_TASK = (100_000, 1_000_000)


def splitters(df: DataFrame, col: str, cells: int = CELLS) -> Column:
    """The ``cells - 1`` distinct values of a column that have the smallest hashes (all, if there are fewer), ascending,
    as a scalar subquery. Columns of any type will do.

    Samples of parts can be merged, and neither the order of the rows nor how often a value occurs matters."""
    values = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull()).distinct()
    sample = values.orderBy(F.xxhash64("v"), "v").limit(cells - 1)
    return sample.agg(F.array_sort(F.collect_list("v")).alias("splits")).scalar()


def with_cell(df: DataFrame, col: str, splits: Column, out: str = "_cell", cells: int = CELLS) -> DataFrame:
    """``out``: how many of the ``splits``, fewer than ``cells``, are not above the value, by binary search; it never
    falls as the value rises, and is 0 for nulls."""
    # each step reads the one before it twice; Spark keeps such projections apart, inside one generated loop
    d = df.withColumn("_splits", splits).withColumn(out, F.lit(0))
    step = cells // 2
    while step:
        under = F.coalesce((F.get("_splits", F.col(out) + (step - 1)) <= F.col(col)).cast("int"), F.lit(0))
        d = d.withColumn(out, F.col(out) + under * step)
        step //= 2
    return d.drop("_splits")


def span(df: DataFrame, col: str) -> Column:
    """``[min, max]`` of a column as a scalar subquery."""
    v = F.col(col).cast("double")
    return df.agg(F.array(F.min(v), F.max(v)).alias("span")).scalar()


def cell(value: Column, bounds: Column, cells: int = CELLS) -> Column:
    """Number of the cell of a value; it never falls as the value rises."""
    v, lo, hi = F.nanvl(value.cast("double"), bounds[1]), bounds[0], bounds[1]
    place = F.floor((v - lo) / (hi - lo) * F.lit(float(cells)))
    return F.when(hi > lo, F.least(F.lit(cells - 1), F.greatest(F.lit(0), place.cast("int")))).otherwise(F.lit(0))


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], partition_cols: Sequence[str] = (),
                descending: bool = False, inclusive: bool = True, then: Sequence[str] = (),
                bounds: Column | None = None, prefix: str = "cum_", cells: int = CELLS,
                splits: Column | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in the order of ``order_col`` (then of the columns ``then``) within
    ``partition_cols``; null partition keys form a group of their own.

    ``splits`` cuts the cells, by default at a sample of the distinct values of ``df``; with ``bounds``, a scalar array of
    the least and the largest value, cells have equal widths. Rows that agree in all order columns are ordered anyhow:
    aggregate first where that matters.
    """
    part = list(partition_cols)
    if bounds is not None:
        d = df.withColumn("_cell", cell(F.col(order_col), bounds, cells))
    else:
        d = with_cell(df, order_col, splits if splits is not None else splitters(df, order_col, cells), cells=cells)
    totals = d.groupBy(*part, "_cell").agg(*[F.sum(c).alias("_t_" + c) for c in sum_cols])
    cell_order = F.col("_cell").desc() if descending else F.col("_cell").asc()
    before = Window.partitionBy(*part).orderBy(cell_order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*part, "_cell"]
    offsets = totals.select(*[F.col(c).alias("_k_" + c) for c in keys],
                            *[F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_o_" + c) for c in sum_cols])
    if not part:
        offsets = F.broadcast(offsets)  # at most CELLS rows
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in keys])
    joined = d.join(offsets, same, "inner")
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (order_col, *then)]
    within = Window.partitionBy(*part, "_cell").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return joined.withColumns({
        prefix + c: F.col("_o_" + c) + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sum_cols
    }).drop("_cell", *["_k_" + c for c in keys], *["_o_" + c for c in sum_cols])


def with_row_number(df: DataFrame, group_col: str, order_cols: Sequence[str], out: str = "rid",
                    partitions: int | None = None) -> DataFrame:
    """A gapless number from 1 in the order of ``group_col``, then ``order_cols``, for any sortable group.

    Rows are numbered inside their group, and the groups' sizes are summed up over the distinct groups; so the only
    window over a group is as large as the group, and none is over the table. ``partitions`` to deal the groups into;
    None leaves it to Spark.
    """
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_size"))
    starts = prefix_sums(sizes, group_col, ["_size"], inclusive=False, prefix="_before",
                         splits=splitters(df, group_col))
    starts = starts.select(F.col(group_col).alias("_group"), F.col("_before_size").alias("_start"))
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    dealt = df.repartition(partitions, group_col) if partitions else df
    numbered = dealt.withColumn("_nth", F.row_number().over(w))
    return (numbered.join(starts, F.col(group_col).eqNullSafe(F.col("_group")), "inner")
            .withColumn(out, (F.col("_start") + F.col("_nth")).cast("long")).drop("_nth", "_group", "_start"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], partition_cols: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy's default) computed distributed.

    Returns ``(partition_cols..., q_index, q, value)``. Values are counted per
    distinct value, ranked with ``prefix_sums``, and the two order statistics
    around each position are picked with a filter — no group is collected.
    """
    part = list(partition_cols)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*part, F.col(col).cast("double").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sums(counts, "_v", ["_n"], part, inclusive=False,
                         splits=splitters(df.withColumn("_v", F.col(col).cast("double")), "_v"))
    total = counts.groupBy(*part).agg(F.sum("_n").alias("_N"))
    if part:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in part])
        cand = ranked.join(total.withColumnsRenamed({c: "_k_" + c for c in part}), same, "inner") \
            .drop(*["_k_" + c for c in part])
    else:
        cand = ranked.withColumn("_N", total.select("_N").scalar())
    qarr = F.array(*[F.struct(F.lit(i).alias("q_index"), F.lit(float(p)).alias("q")) for i, p in enumerate(probs)])
    cand = cand.withColumn("_qq", F.explode(qarr)).withColumns(
        {"q_index": F.col("_qq.q_index"), "q": F.col("_qq.q")}).drop("_qq")
    cand = cand.withColumn("_h", (F.col("_N") - 1) * F.col("q")).withColumns({
        "_lo": F.floor("_h").cast("long"), "_hi": F.ceil("_h").cast("long")})
    # value at rank r is the row with cum_n <= r < cum_n + n
    at = {c: (F.col("cum__n") <= F.col(c)) & (F.col(c) < F.col("cum__n") + F.col("_n")) for c in ("_lo", "_hi")}
    picked = cand.filter(at["_lo"] | at["_hi"]).withColumns({
        "_vlo": F.when(at["_lo"], F.col("_v")), "_vhi": F.when(at["_hi"], F.col("_v"))})
    out = picked.groupBy(*part, "q_index", "q").agg(F.max("_vlo").alias("_vlo"), F.max("_vhi").alias("_vhi"),
                                                    F.first("_h").alias("_h"))
    return out.select(*part, "q_index", "q", (F.col("_vlo") + (F.col("_h") - F.floor("_h")) *
                                              (F.col("_vhi") - F.col("_vlo"))).alias("value"))
