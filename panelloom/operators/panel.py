"""Cleaning, returns and daily sums of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_ln
from .scan import ROWS, framed


def clean_latest(raw: DataFrame, keys: list[str], observed: str, floor: float, since: str | None = None, period: str = "period") -> DataFrame:
    """Valid observations, the latest of each key; validity comes first, so that a bad late one hides no good early one.

    Equal times are told apart by the larger value.
    """
    ok = raw.where(F.col("value").isNotNull() & (F.col("value") > floor))
    if since is not None:
        ok = ok.where(F.col(period) >= F.lit(since).cast("date"))
    latest = Window.partitionBy(*keys).orderBy(F.col(observed).desc(), F.col("value").desc())
    return ok.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")


def with_returns(panel: DataFrame, step: str = "day", high_rows: int = 8) -> DataFrame:
    """Log return over adjacent periods only, and drawdown from the highest of the last rows.

    A return needs the row before to be one step earlier and positive; the drawdown asks for no adjacency.
    """
    by = Window.partitionBy("entity").orderBy("period")
    high = F.max("value").over(by.rowsBetween(1 - high_rows, 0))
    before, value = F.lag("value").over(by), F.col("value")
    then = F.lag("period").over(by)
    gap = F.datediff("period", then) if step == "day" else F.timestamp_diff("HOUR", then, F.col("period"))
    # The logarithm of a ratio, as levels may differ by orders of magnitude.
    ret = F.when((gap == 1) & (before > 0), safe_ln(F.try_divide(value, before)))
    down = F.when(high > 0, F.try_divide(value, high) - 1.0)
    return panel.withColumn("log_return", ret).withColumn("drawdown", down)


def series_flow(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """(period, value, log_flow): the change of an aggregate series over adjacent days."""

    def flow(w):
        before, then = F.lag("value").over(w), F.lag("period").over(w)
        return {"log_flow": F.when((F.datediff("period", then) == 1) & (before > 0), safe_ln(F.try_divide(F.col("value"), before)))}

    return framed(series, ["period"], 1, 0, flow, rows)


def system_daily(returns: DataFrame, flows: DataFrame, min_active: int = 6) -> DataFrame:
    """One row for each period with enough returns: sums over entities that have one, and the series' flow."""
    daily = (
        returns.where(F.col("log_return").isNotNull())
        .groupBy("period")
        .agg(
            F.sum("value").alias("total_value"),
            F.avg("log_return").alias("equal_weight_return"),
            F.avg((F.col("log_return") < 0).cast("double")).alias("downside_breadth"),
            F.count("log_return").alias("n_active"),
            F.min("drawdown").alias("worst_drawdown"),
        )
        .where(F.col("n_active") >= min_active)
    )
    return daily.join(flows.select("period", F.col("value").alias("series_value"), F.col("log_flow").alias("series_flow")), "period", "left")


def entity_metadata(panel: DataFrame) -> DataFrame:
    return panel.select("entity", "category").distinct()


def entity_coverage(returns: DataFrame) -> DataFrame:
    """Rows, returns and first and last period of each entity."""
    return returns.groupBy("entity").agg(
        F.max("category").alias("category"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n_rows"), F.count("log_return").alias("n_returns")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_keys, n_surplus): zero surplus if the keys are unique; keys are counted before they are shuffled."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("n_surplus", F.col("n_rows") - F.col("n_keys"))


def common_history(wide: DataFrame, start: DataFrame, share: float = 0.95) -> DataFrame:
    """Entities that return by the start and on enough of all periods since; wide has every cell, start one row (start)."""
    cells = wide.crossJoin(F.broadcast(start))  # one row
    got = cells.groupBy("entity").agg(
        F.min(F.when(F.col("log_return").isNotNull(), F.col("period"))).alias("first_return"),
        F.max("start").alias("start"),
        F.avg(F.when(F.col("period") >= F.col("start"), F.col("log_return").isNotNull().cast("double"))).alias("share"),
    )
    return got.withColumn("member", F.coalesce((F.col("first_return") <= F.col("start")) & (F.col("share") >= share), F.lit(False)))


def factor_control(levels: DataFrame, until: str | None = None) -> DataFrame:
    """(period, level, factor_return): a factor without gaps; a missing day is an error."""
    from .timeindex import missing_days

    kept = levels if until is None else levels.where(F.col("period") <= F.lit(until).cast("date"))
    gap = missing_days(kept).limit(1).collect()
    if gap:
        raise ValueError(f"the factor has no value for {gap[0][0]}")
    return framed(kept, ["period"], 1, 0, lambda w: {"factor_return": safe_ln(F.col("level")) - safe_ln(F.lag("level").over(w))})
