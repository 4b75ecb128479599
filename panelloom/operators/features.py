"""The frame of predictors, one row for each period from the first full network window on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_drawdown
from .scan import framed
from .timeindex import forward_sum, rolling_std, rolling_sum, stress_label

COMPONENTS = ("correlation", "density", "contraction", "volatility", "breadth")
MOMENTUM = "momentum"
# The heuristic score's weights.
WEIGHTS = {"correlation": 0.25, "density": 0.20, "contraction": 0.20, "volatility": 0.20, "breadth": 0.15}


def breadth(cells: DataFrame, value: str, name: str = "breadth", mean: str | None = None) -> DataFrame:
    """Share of the returns present that are negative, and on demand their mean."""
    out = [F.try_divide(F.count_if(F.col(value) < 0), F.count(value)).alias(name)]
    return cells.groupBy("period").agg(*out, *([F.avg(value).alias(mean)] if mean else []))


def feature_frame(cells: DataFrame, net: DataFrame, baskets: DataFrame, flows: DataFrame, horizon: int = 7, drawdown: float = 0.05, residual: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Components, momentum, forward return and label; residual: (residual network, residual cells)."""
    f = net.select("period", "n", F.col("mean_correlation").alias("correlation"), "density")
    if residual is not None:  # either network may have periods that the other lacks
        res_net = residual[0].select("period", F.col("n").alias("res_n"), F.col("residual_mean_correlation").alias("residual_correlation"), "residual_density")
        f = f.join(res_net, "period", "full").withColumn("n", F.coalesce("n", "res_n")).drop("res_n")
    f = f.join(baskets.drop("n"), "period", "left").join(flows.select("period", F.col("log_flow").alias("flow")), "period", "left")
    f = f.join(breadth(cells, "ret"), "period", "left")
    more = {}
    if residual is not None:
        f = f.join(breadth(residual[1], "residual", "residual_breadth", "residual_return"), "period", "left")
        more = {"residual_volatility": ("residual_return", 30)}

    def rolling(_):
        at = {"order": "_i", "partition": ("_part",)}
        return {
            "contraction": -rolling_sum("flow", 7, **at),
            "volatility": rolling_std("equal_weight", 30, **at),
            MOMENTUM: -rolling_sum("equal_weight", 7, **at),
            "forward_return": forward_sum("equal_weight", horizon, **at),
        } | {k: rolling_std(*v, **at) for k, v in more.items()}

    f = framed(f, ["n"], 29, horizon, rolling)
    return f.withColumn("label", stress_label(F.col("forward_return"), log_drawdown(drawdown)))


def valid_rows(frame: DataFrame, needed: tuple[str, ...] = (*COMPONENTS, MOMENTUM, "label")) -> DataFrame:
    return frame.dropna("any", subset=list(needed))
