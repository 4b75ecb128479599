"""Checks of panels, features, folds and results: (check, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import duplicate_keys
from .timeindex import missing_days


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return duplicate_keys(df, keys).select(F.lit(name).alias("check"), (F.col("n_surplus") == 0).alias("passed"))


def tail_unobservable(frame: DataFrame, horizon: int, name: str = "labels of the last rows are null") -> DataFrame:
    last = frame.agg(F.max("n").alias("last"))
    tail = frame.crossJoin(F.broadcast(last)).where(F.col("n") > F.col("last") - horizon)  # one row
    return tail.agg((F.count("label") == 0).alias("passed")).select(F.lit(name).alias("check"), "passed")


def chronology(folds: DataFrame, purge: int, name: str = "training ends before the purge of each fold") -> DataFrame:
    """folds: (task, role, period, ...)."""
    ends = folds.groupBy("task").agg(F.max(F.when(F.col("role") == "train", F.col("period"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("period"))).alias("b"))
    return ends.agg(F.coalesce(F.bool_and(F.col("a") < F.date_sub("b", purge)), F.lit(True)).alias("passed")).select(F.lit(name).alias("check"), "passed")


def complete_calendar(df: DataFrame, name: str = "the calendar has no gap") -> DataFrame:
    return missing_days(df).agg((F.count(F.lit(1)) == 0).alias("passed")).select(F.lit(name).alias("check"), "passed")


def row_count(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.agg((F.count(F.lit(1)) == n).alias("passed")).select(F.lit(name).alias("check"), "passed")


def columns_there(df: DataFrame, names: tuple[str, ...], name: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    return df.sparkSession.createDataFrame([(name, not missing)], "check string, passed boolean")


def reconciles(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12, name: str = "tables agree") -> DataFrame:
    """The same keys with values that differ by less than the tolerance."""
    sides = [df.select(*keys, F.struct(F.col(value).alias("v")).alias(side)) for df, side in ((a, "_a"), (b, "_b"))]
    both = sides[0].join(sides[1], keys, "full")
    x, y = F.col("_a.v"), F.col("_b.v")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.coalesce(F.abs(x - y) < tolerance, x.isNull() & y.isNull())
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("passed")).select(F.lit(name).alias("check"), "passed")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Raise if any check failed."""
    failed = [r["check"] for r in checks.where("NOT passed").collect()]
    if failed:
        raise RuntimeError("failed checks: " + "; ".join(failed))
