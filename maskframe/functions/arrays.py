"""Column functions over arrays of numbers; all stay inside the row, so none shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body reads it, within lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind_fields(body: Callable[[Column], Column], **values: Column) -> Column:
    """As ``bind``, for several values that the body reads as fields."""
    return bind(F.struct(*(v.alias(name) for name, v in values.items())), body)


def total(a: ColumnLike) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def mean(a: ColumnLike) -> Column:
    return F.try_divide(total(a), F.size(col(a)))


def doubles(a: ColumnLike) -> Column:
    return col(a).cast("array<double>")


def folded(channels: ColumnLike, combine: Callable[[Column, Column], Column]) -> Column:
    """Channels of one length, [channel][pixel], put together pixel by pixel; null without channels."""
    return bind(col(channels), lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), lambda sofar, x: F.zip_with(sofar, x, combine)))


def added(channels: ColumnLike) -> Column:
    """Sum of channels, pixel by pixel."""
    return folded(channels, lambda x, y: x + y)


def sequence0(n: Column | int) -> Column:
    """0 to n - 1; empty for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def sorted_quantile(a: ColumnLike, q: float) -> Column:
    """Quantile with linear interpolation; null for an empty array."""
    return bind(ascending(a), lambda s: quantile_of_sorted(s, q))


def ascending(a: ColumnLike) -> Column:
    """Sorted, nulls last."""
    return bind(col(a), lambda v: F.when(F.exists(v, lambda x: x.isNull()), F.array_sort(v)).otherwise(F.sort_array(v)))


def quantile_of_sorted(s: Column, q: float) -> Column:
    """``sorted_quantile`` of an array that is sorted already."""
    rank = (F.size(s) - 1) * F.lit(float(q))
    lo = F.floor(rank).cast("int")
    low, high = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
    return low + (high - low) * (rank - lo)


def argmax(a: ColumnLike) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def transpose(a: ColumnLike) -> Column:
    """array[i][j] as array[j][i]."""
    return bind(col(a), lambda m: F.transform(sequence0(F.size(F.get(m, F.lit(0)))), lambda j: F.transform(m, lambda row: F.get(row, j))))


def finite(a: ColumnLike) -> Column:
    """Whether an array is non-empty and all its elements are finite."""
    inf = F.lit(float("inf"))
    return (F.size(col(a)) > 0) & ~F.exists(doubles(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
