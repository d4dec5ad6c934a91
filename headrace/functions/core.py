"""Missing values, safe arithmetic and small column helpers.

Missing is NULL everywhere: NaN and infinities become NULL at the source, so
that Spark aggregates skip them, and a division that has no answer is NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """NULL unless the value is an ordinary number."""
    c = col(c)
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """P-1: replace NaN and infinities by NULL in the floating-point columns."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wanted = floating if columns is None else floating & set(columns)
    return df.select(*[finite(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def number(c: ColumnLike) -> Column:
    """P-3: text to DOUBLE; unreadable, NaN and infinite text is NULL."""
    return finite(F.trim(col(c).cast("string")).try_cast("double"))


def round_even(c: ColumnLike, digits: int = 0) -> Column:
    """A DOUBLE rounded half to even after scaling in doubles, as NumPy and SQL do; ``bround`` would round its decimal text."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def clip(c: ColumnLike, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` and ``least`` skip NULL)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    return F.try_divide(col(a), col(b))


def bounded_change(base: ColumnLike, new: ColumnLike) -> Column:
    """X-12: symmetric relative change in [-1, 1]."""
    a, b = col(base), col(new)
    return (b - a) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def circular_shift(base: ColumnLike, new: ColumnLike, period: float = 365.0) -> Column:
    """Signed shortest distance between two days of the year."""
    d = F.pmod(col(new) - col(base), F.lit(period))
    return F.when(d > period / 2, d - period).otherwise(d)


def weighted_mean(value: ColumnLike, weight: ColumnLike) -> Column:
    """A-8: aggregate; rows where either part is missing do not count."""
    v, w = col(value), col(weight)
    both = v.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w)))


def optional_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``; columns the input lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike]) -> DataFrame:
    """U-2: one row per key, the first in ``order`` (a total order).

    An aggregate, not a window: copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_non_null(value: ColumnLike, order: ColumnLike) -> Column:
    """Aggregate: first non-NULL value of one column in a stated order."""
    v = col(value)
    return F.min_by(v, F.when(v.isNotNull(), col(order)))


def tidy(nat: ColumnLike, reg: ColumnLike) -> list[Column]:
    """P-23: the delta and ratio columns of a metric row."""
    n, r = col(nat), col(reg)
    return [
        n.alias("value_nat"),
        r.alias("value_reg"),
        (r - n).alias("delta"),
        F.when(n != 0, F.try_divide(r, n)).alias("ratio"),
    ]


#: Rows up to which a counted side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
