"""Column rules where an unknown input has to stay unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(value: Column) -> Column:
    """Sum that is null as soon as one value is null."""
    return F.when(F.count(F.when(value.isNull(), 1)) == 0, F.sum(value))


def strict_least(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def strict_greatest(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    """Quotient of doubles; null instead of an infinite or undefined value."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def distinct_with_null(value: Column) -> Column:
    """Number of distinct values where null counts as one of them."""
    return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def safe_log10(value: Column) -> Column:
    return F.when(value > 0, F.log10(value))


def safe_ln(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def bucket(value: Column, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """Number of the half-open interval (a, b] that holds ``value``.

    The lowest break itself is in no interval unless ``include_lowest`` is set;
    neither is a value beyond the highest break.
    """
    below = sum((F.lit(float(b)) < value).cast("int") for b in breaks)
    if include_lowest:
        below = F.when(value == float(breaks[0]), F.lit(1)).otherwise(below)
    return F.when((below > 0) & (value <= float(breaks[-1])), below)


def bucket_bounds(number: Column, breaks: Sequence[float]) -> tuple[Column, Column]:
    """Lower and upper break of an interval number."""
    points = F.array(*[F.lit(float(b)) for b in breaks])
    return F.get(points, number - 1), F.get(points, number)


def in_band(
    estimated: Column, recorded: Column, upper: float = 1.8, lower: float = 0.8, places: int = 9
) -> Column:
    """1 where estimated / recorded lies in (lower, upper], else 0.

    The quotient is rounded first so that one sitting on a bound does not
    depend on the last bit of the division.
    """
    share = F.round(ratio(estimated, recorded), places)
    return ((share <= upper) & (share > lower)).cast("int")


def bigger_side(estimated: Column, recorded: Column, places: int = 9) -> Column:
    """1, 0 or -1 for an estimate above, equal to or below the record."""
    share = F.round(ratio(estimated, recorded), places)
    return F.when(share.isNotNull(), F.signum(F.round(share - 1, places)).cast("int"))
