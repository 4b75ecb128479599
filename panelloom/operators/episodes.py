"""Runs of stress and of false alerts, and what surrounds their onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import COMPONENTS
from .scan import runs


def alerts(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """rows (period, label, score) with alert, from a table of one row (threshold)."""
    return rows.crossJoin(F.broadcast(threshold)).withColumn("alert", (F.col("score") >= F.col("threshold")).cast("int")).drop("threshold")  # one row


def stress_episodes(rows: DataFrame, cells: DataFrame, frame: DataFrame, days: int = 7, top: int = 3) -> DataFrame:
    """One row for each run of label 1: extent, severity, alerts before and after its onset, and worst entities.

    Alerts count in [onset - days, onset), returns in (onset, onset + days].
    """
    each = runs(rows, ["period"], F.col("label") == 1, "episode").groupBy("episode").agg(F.min("period").alias("onset"), F.max("period").alias("end"), F.count(F.lit(1)).alias("duration"), F.max("alert").alias("alert_from_onset"))
    before = each.select("episode", "onset", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_k")).withColumn("period", F.expr("date_sub(onset, _k)"))
    lead = before.join(rows.where("alert = 1").select("period"), "period").groupBy("episode").agg(F.min("_k").alias("lead_days"))
    after = each.select("episode", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_add("onset", k))).alias("period"))
    drops = after.join(cells.select("period", "entity", "ret"), "period").groupBy("episode", "entity").agg(F.sum("ret").alias("s"))
    order = Window.partitionBy("episode").orderBy(F.asc_nulls_last("s"), "entity")
    worst = drops.withColumn("k", F.row_number().over(order)).where((F.col("k") <= top) & F.col("s").isNotNull())
    worst = worst.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("k", F.format_string("%s:%.3f", F.col("entity").cast("string"), "s").alias("t")))).alias("w"))
    worst = worst.select("episode", F.array_join(F.transform("w", lambda x: x["t"]), "; ").alias("worst_entities"))
    out = each.join(lead, "episode", "left").join(worst, "episode", "left").join(frame.select(F.col("period").alias("onset"), "forward_return"), "onset", "left")
    pre = F.col("lead_days").isNotNull()
    return out.select(
        "episode", "onset", "end", "duration", "forward_return", (1.0 - F.exp("forward_return")).alias("severity"), pre.cast("int").alias("pre_onset_alert"), "lead_days", "alert_from_onset",
        (~pre & (F.col("alert_from_onset") == 1)).cast("int").alias("after_onset_only"), F.coalesce("worst_entities", F.lit("")).alias("worst_entities"),
    )


def false_alert_runs(rows: DataFrame) -> DataFrame:
    got = runs(rows, ["period"], (F.col("alert") == 1) & (F.col("label") == 0), "run")
    return got.groupBy("run").agg(F.min("period").alias("start"), F.max("period").alias("end"), F.count(F.lit(1)).alias("duration"), F.max("score").alias("max_score"))


def event_study(episodes: DataFrame, frame: DataFrame, span: int = 14) -> DataFrame:
    """Mean basket return and components by distance from the onset; periods that the frame lacks are skipped."""
    at = episodes.select(F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset"), "onset").withColumn("period", F.expr("date_add(onset, offset)"))
    names = ("equal_weight", *COMPONENTS)
    return at.join(frame, "period").groupBy("offset").agg(F.count(F.lit(1)).alias("episodes"), *[F.avg(c).alias(f"mean_{c}") for c in names])


def event_study_z(episodes: DataFrame, frame: DataFrame, train: DataFrame, span: int = 14) -> DataFrame:
    """event_study of components as distances from their training mean, in training deviations (of the population)."""
    moments = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in COMPONENTS], *[F.stddev_pop(c).alias(f"_s_{c}") for c in COMPONENTS])
    z = frame.crossJoin(F.broadcast(moments))  # one row
    z = z.select("period", *[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in COMPONENTS])
    at = episodes.select(F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset"), "onset").withColumn("period", F.expr("date_add(onset, offset)"))
    return at.join(z, "period").groupBy("offset").agg(*[F.avg(c).alias(f"z_{c}") for c in COMPONENTS])
