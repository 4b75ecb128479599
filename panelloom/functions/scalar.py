"""Column expressions whose treatment of missing values matters."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """c within bounds; null stays null (greatest and least skip nulls and would make it a bound)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def safe_ln(c: Column) -> Column:
    """Natural logarithm; null for null, zero and negative numbers."""
    return F.when(c > 0, F.ln(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def sigmoid(c: Column, bound: float = 35.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, -bound, bound)))


def no_nan(c: Column) -> Column:
    """NaN as null: panels mark what is missing with null alone."""
    return F.when(~F.isnan(c), c)


def gated(value: Column, counted: Column, least: int, w: WindowSpec) -> Column:
    """A window aggregate where at least `least` rows of the frame have `counted`."""
    return F.when(F.count(counted).over(w) >= least, value.over(w))


def rows_of(partition: list[str], order: str, first: int, last: int) -> WindowSpec:
    return (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(order).rowsBetween(first, last)


def utc_day(seconds: Column) -> Column:
    """Day of a unix time, rounded down."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def nearest_utc_day(seconds: Column) -> Column:
    """Day of a unix time, to the nearest midnight; half-days go to the even day."""
    return F.date_from_unix_date(F.bround(seconds / F.lit(86400.0)).cast("int"))


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def log_drawdown(share: float) -> float:
    return math.log(1 - share)
