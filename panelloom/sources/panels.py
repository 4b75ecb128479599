"""Panels over the test tables: (entity, category, period, value), unique on (entity, period)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven entities over a long daily history."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").cast("int").alias("entity"), F.to_date("l_shipdate").alias("period"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
        .select("entity", (F.col("entity") % 3).cast("int").alias("category"), "period", "value")
    )


def event_panel(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Eight entities by hour or day, with gaps."""
    period = F.date_trunc("hour", "ts").cast("timestamp_ntz") if unit == "hour" else F.to_date("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 8).cast("int").alias("entity"), period.alias("period"))
        .agg(F.round(F.sum("value"), 2).alias("value"))
        .select("entity", (F.col("entity") % 3).cast("int").alias("category"), "period", "value")
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations before deduplication: (entity, category, period, observed_at, value)."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("entity"), F.col("event_type").alias("category"), F.to_date("ts").alias("period"), F.col("ts").alias("observed_at"), "value"
    )


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate series by day, with gaps: (period, value)."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def quantity_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor's level by day: (period, level)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("period")).agg(F.round(F.sum("l_quantity"), 2).alias("level"))
