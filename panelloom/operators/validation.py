"""How scores hold up over time, and under other lags and horizons."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import log_drawdown
from .features import COMPONENTS, MOMENTUM, WEIGHTS
from .metrics import average_ranks, pearson, rank_metrics
from .scoring import apply_scaler, fit_scaler, long_scores, weighted, with_roles
from .scan import framed
from .timeindex import forward_sum, stress_label


def rolling_performance(scores: DataFrame, size: int = 180, step: int = 30) -> DataFrame:
    """Metrics of each model over windows of `size` rows that end every `step` rows.

    A row is dealt to the windows that hold it; scores: (model, period, label, score).
    """
    by = Window.partitionBy("model")
    rows = scores.withColumns({"r": F.row_number().over(by.orderBy("period")), "n": F.count(F.lit(1)).over(by)})
    first = F.greatest(F.lit(0), F.ceil((F.col("r") - size) / step)).cast("int")
    last = F.floor((F.least(F.col("r") + (size - 1), F.col("n")) - size) / step).cast("int")
    rows = rows.withColumns({"a": first, "b": last}).where("b >= a AND n >= " + str(size)).withColumn("window", F.explode(F.sequence("a", "b")))
    keys = ["model", "window"]
    span = rows.groupBy(*keys).agg(F.min("period").alias("window_start"), F.max("period").alias("window_end"), F.avg("label").alias("prevalence"))
    ranked = rows.withColumns({"x": average_ranks("score", keys), "y": average_ranks("label", keys)})
    rho = ranked.groupBy(*keys).agg(pearson(F.col("x"), F.col("y")).alias("rank_correlation"))
    return span.join(rank_metrics(rows, keys), keys).join(rho, keys)


def lag_horizon(frame: DataFrame, start: DataFrame, horizons: tuple[int, ...] = (3, 7, 14), lags: tuple[int, ...] = (0, 1, 3, 7), drawdown: float = 0.05) -> DataFrame:
    """Holdout metrics of the heuristic and each component for every horizon and lag; start: one row (holdout_start).

    Predictors are lagged by rows, the purge is as long as the horizon, and each cell has its own scaler.
    """
    names, at = (*COMPONENTS, MOMENTUM), {"order": "_i", "partition": ("_part",)}
    # One pass over the rows computes all lags and labels; a row then stands once for each horizon and lag.
    wide = framed(frame.select("period", "n", "equal_weight", *names), ["n"], max(lags), max(horizons), lambda w: {f"{c}_{k}": F.lag(c, k).over(w) for c in names for k in lags} | {f"label_{h}": stress_label(forward_sum("equal_weight", h, **at), log_drawdown(drawdown)) for h in horizons})
    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("lag"), *[F.col(f"{c}_{k}").alias(c) for c in names], F.col(f"label_{h}").alias("label")) for h, k in product(horizons, lags)]
    every = wide.select("period", F.explode(F.array(*cells)).alias("x")).select("period", "x.*").dropna("any", subset=[*names, "label"])
    every = with_roles(every.crossJoin(F.broadcast(start)), F.col("horizon"))  # one row
    by = ("horizon", "lag")
    z = apply_scaler(every.where("role = 'test'"), fit_scaler(every.where("role = 'train'"), COMPONENTS, by), COMPONENTS, by)
    scores = long_scores(z, {"heuristic": weighted(WEIGHTS)} | {c: F.col(f"z_{c}") for c in COMPONENTS}, (*by, "period", "label"))
    return rank_metrics(scores, [*by, "model"]).withColumn("prevalence", F.col("events") / F.col("observations"))
