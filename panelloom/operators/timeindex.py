"""Rows in time: a dense index of periods, a scaffold of all cells, and rolling sums over rows.

Numbers of all rows in order come from ranges (scan.py), never from a window without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gated, rows_of
from .scan import ROWS, numbered


def dense_index(df: DataFrame, period: str = "period", rows: int = ROWS) -> DataFrame:
    """(period, n): distinct periods numbered from 1 in order."""
    return numbered(df.select(period).distinct(), [period], "n", rows=rows)


def scaffold(panel: DataFrame, columns: list[str], keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Every (entity, period) cell, missing ones with null columns, with the index n of its period."""
    calendar = dense_index(panel)
    entities = panel.select(*keys).distinct()
    return calendar.crossJoin(entities).join(panel.select("entity", "period", *columns), ["entity", "period"], "left")


def rolling_sum(c: str, size: int, order: str = "n", partition: tuple[str, ...] = ()) -> Column:
    """Sum of the last `size` rows, the current one included; null unless all are there."""
    w = rows_of(list(partition), order, 1 - size, 0)
    return gated(F.sum(c), F.col(c), size, w)


def rolling_std(c: str, size: int, order: str = "n", partition: tuple[str, ...] = ()) -> Column:
    """Sample standard deviation of the last `size` rows; null unless all are there."""
    w = rows_of(list(partition), order, 1 - size, 0)
    return gated(F.stddev_samp(c), F.col(c), size, w)


def forward_sum(c: str, horizon: int, order: str = "n", partition: tuple[str, ...] = ()) -> Column:
    """Sum of the next `horizon` rows, without the current one; null unless all are there."""
    w = rows_of(list(partition), order, 1, horizon)
    return gated(F.sum(c), F.col(c), horizon, w)


def stress_label(forward: Column, log_floor: float) -> Column:
    """1 if the forward sum is at or below the floor, else 0; null while it cannot be observed."""
    return F.when(forward.isNotNull(), (forward <= log_floor).cast("int"))


def last_known(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key that is not null: what filling forward leaves on the last row."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def missing_days(df: DataFrame, period: str = "period") -> DataFrame:
    """Days between the first and the last that have no row."""
    span = df.agg(F.min(period).alias("a"), F.max(period).alias("b")).where("a IS NOT NULL")
    days = span.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias(period))
    return days.join(df.select(period).distinct(), period, "left_anti")


def tumbling_mean(df: DataFrame, value: str, days: int, period: str = "period") -> DataFrame:
    """Mean by spans of `days` from the first day on; spans without a value are left out."""
    first = df.agg(F.min(period).alias("first"))
    slot = F.floor(F.datediff(period, "first") / days).cast("int")
    out = df.crossJoin(F.broadcast(first)).groupBy(F.expr(f"date_add(first, {days} * cast(floor(datediff({period}, first) / {days}) as int))").alias("slot_start"), slot.alias("slot"))  # one row
    return out.agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())
