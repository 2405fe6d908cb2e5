"""Column helpers that pin the null, NaN and rounding rules used everywhere.

Ratios are null-safe (``try_divide`` semantics under ANSI mode), a clamp maps a
missing or non-finite input to its low bound, and a correlation over a constant
side is null instead of a division error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int


def col(value: ColumnLike) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))


def finite(value: ColumnLike) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = col(value)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clamp(value: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to [low, high]; null and NaN become low.

    The argument appears once, so nested clamps do not multiply the plan; ratios
    built with ``ratio`` are null rather than infinite for a zero denominator.
    """
    lo, hi = F.lit(float(low)), F.lit(float(high))
    return F.least(F.greatest(F.nanvl(col(value).cast("double"), lo), lo), hi)


def ratio(num: ColumnLike, den: ColumnLike, default: float | None = 0.0) -> Column:
    """num / den with a default for a zero or missing denominator."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def ramp(value: ColumnLike, low: float, high: float) -> Column:
    """0 at or below low, 1 at or above high, linear in between."""
    return clamp((col(value) - F.lit(float(low))) / F.lit(float(high - low)))


def band(value: ColumnLike, low: float, high: float, soft: float) -> Column:
    """1 inside [low, high], falling to 0 over a margin of `soft` outside it."""
    c = col(value)
    outside = F.greatest(F.lit(float(low)) - c, c - F.lit(float(high)), F.lit(0.0))
    return clamp(F.lit(1.0) - outside / F.lit(float(soft)))


def mean_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) / F.lit(float(len(terms)))


def flag(cond: Column) -> Column:
    """A condition as 1.0 / 0.0 (null counts as false)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def round_even(value: ColumnLike, digits: int) -> Column:
    """Scale, round half to even, scale back: the array-library rounding rule."""
    scale = F.lit(float(10**digits))
    return F.rint(col(value) * scale) / scale


def padded(text: ColumnLike, size: int = 6) -> Column:
    """Zeros in front up to ``size`` characters; longer texts stay whole."""
    c = col(text).cast("string")
    return F.lpad(c, F.greatest(F.lit(size), F.length(c)), F.lit("0"))


def share(cond: Column) -> Column:
    """Aggregate: share of rows where the condition holds."""
    return F.avg(flag(cond))


def corr_or_null(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: Pearson correlation, null when either side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def strict(agg: Column, counted: ColumnLike, window, n: int) -> Column:
    """A rolling aggregate that is null until n non-null rows fill the frame."""
    return F.when(F.count(col(counted)).over(window) == n, agg.over(window))


def reasons(pairs: list[tuple[Column, str]], fallback: str) -> Column:
    """Texts whose condition holds, in order, or the fallback text."""
    texts = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(fallback)))
