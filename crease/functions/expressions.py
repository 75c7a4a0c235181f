"""Scalar column expressions (all JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_or", "tcast", "safe_divide", "phase_expr", "matchup_key", "classify_threshold",
    "format_metric_ci", "impact_tier", "season_int", "weighted_sum", "num", "with_portable_uniform",
    "portable_uniform_sql",
]


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tcast(c, dtype: str) -> Column:
    """ANSI-safe cast: unparsable values become null instead of raising."""
    return col_or(c).try_cast(dtype)


def known(c) -> Column:
    """The value as double; NaN counts as missing."""
    return F.nanvl(col_or(c).cast("double"), F.lit(None).cast("double"))


def zero(c) -> Column:
    """The value as double, 0 where it is missing (null or NaN)."""
    return F.coalesce(known(c), F.lit(0.0))


def num(c, default: float = 0.0) -> Column:
    """Numeric coerce: bad or missing values (text, null, NaN) become ``default`` (ANSI-safe)."""
    return F.coalesce(known(tcast(col_or(c), "double")), F.lit(float(default)))


def safe_divide(numerator, denominator) -> Column:
    """``numerator / denominator``; a zero or missing (null, NaN) part gives 0.0."""
    return F.coalesce(known(numerator) / F.nullif(known(denominator), F.lit(0.0)), F.lit(0.0))


def phase_expr(over, bins: Iterable[tuple[str, int, int]], other: str = "Other") -> Column:
    """Phase label from an over number; first matching ``[lo, hi]`` bin wins."""
    over = col_or(over)
    expr = None
    for name, lo, hi in bins:
        cond = over.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def matchup_key(team_a, team_b) -> Column:
    """Unordered pair label ``"A vs B"`` with A <= B."""
    a, b = col_or(team_a).cast("string"), col_or(team_b).cast("string")
    return F.concat(F.least(a, b), F.lit(" vs "), F.greatest(a, b))


def classify_threshold(p, threshold: float = 0.5) -> Column:
    return (col_or(p) >= F.lit(threshold)).cast("int")


def format_metric_ci(value, lower, upper, precision: int = 4) -> Column:
    """``"0.8523 [0.8421, 0.8625]"``; a null/NaN value gives ``"N/A"``."""
    v, lo, hi = col_or(value), col_or(lower), col_or(upper)
    fmt = f"%.{precision}f [%.{precision}f, %.{precision}f]"
    return F.when(v.isNull() | F.isnan(v), F.lit("N/A")).otherwise(F.format_string(fmt, v, lo, hi))


# Impact rating tiers (lower bound, interpretation, selection priority),
# highest first; below the last bound is the floor tier.
IMPACT_TIERS = [
    (90.0, "Elite performer", "Must select"),
    (75.0, "Strong performer", "High priority"),
    (60.0, "Above average", "Consider for balance"),
    (40.0, "Average", "Situational"),
]
IMPACT_TIER_FLOOR = ("Below average", "Avoid unless specialized role")


def impact_tier(rating, field: int = 1) -> Column:
    """Tier of a 0-100 rating: ``field`` 1 = interpretation, 2 = selection priority."""
    r = col_or(rating)
    expr = None
    for tier in IMPACT_TIERS:
        cut, name = tier[0], tier[field]
        expr = F.when(r >= cut, F.lit(name)) if expr is None else expr.when(r >= cut, F.lit(name))
    return expr.otherwise(F.lit(IMPACT_TIER_FLOOR[field - 1]))


def season_int(season) -> Column:
    """Season as an integer; ``"2007/08"`` and other non-integers become null."""
    s = col_or(season)
    as_double = tcast(s.cast("string"), "double")
    return F.when(as_double == F.floor(as_double), as_double.cast("int"))


def weighted_sum(columns: Iterable[str], weights: Iterable[float]) -> Column:
    terms = [zero(c) * F.lit(float(w)) for c, w in zip(columns, weights)]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


# Portable pseudo-random numbers: integer arithmetic that gives the same value
# in Spark SQL and in any SQL engine with 64-bit integers (no engine-specific
# hash). Every intermediate product stays below 2**62.
HASH_MOD = 2147483647


def with_portable_uniform(df, id_col, salt, seed: int = 42, out: str = "_u"):
    """Add a deterministic u in [0, 1) from an integer id, an integer salt and a seed.

    Both halves of the id count: its remainder by the modulus and its quotient.
    Each mixing step is its own projection: the squaring steps reference the
    previous value twice, and Spark keeps such projections apart instead of
    inlining (and duplicating) them.
    """
    m = F.lit(HASH_MOD).cast("long")
    s = (col_or(salt) if not isinstance(salt, int) else F.lit(salt)).cast("long")
    i = col_or(id_col).cast("long")
    d = df.withColumns({"_hi": F.pmod(i, m), "_hq": F.call_function("div", i - F.pmod(i, m), m)})
    d = d.withColumn("_hx", (F.col("_hi") * 48271 + F.col("_hq") * 40692 + s * 69621 + F.lit(seed).cast("long")) % m)
    d = d.withColumn("_hx", (F.col("_hx") * F.col("_hx") + 12345) % m)
    d = d.withColumn("_hx", (F.col("_hx") * 48271 + F.col("_hi")) % m)
    d = d.withColumn("_hx", (F.col("_hx") * F.col("_hx") + 777) % m)
    return d.withColumn(out, F.col("_hx").cast("double") / F.lit(float(HASH_MOD))).drop("_hi", "_hq", "_hx")


def portable_uniform_sql(id_expr: str, salt_expr: str, seed: int = 42) -> str:
    """The same function as SQL text (for the DuckDB oracle)."""
    m = HASH_MOD
    i = f"(CAST({id_expr} AS BIGINT) % {m})"
    q = f"(CAST({id_expr} AS BIGINT) // {m})"
    x = f"(({i} * 48271 + {q} * 40692 + CAST({salt_expr} AS BIGINT) * 69621 + {seed}) % {m})"
    x = f"(({x} * {x} + 12345) % {m})"
    x = f"(({x} * 48271 + {i}) % {m})"
    x = f"(({x} * {x} + 777) % {m})"
    return f"(CAST({x} AS DOUBLE) / {float(m)!r}E0)".replace(".0E0", ".0")
