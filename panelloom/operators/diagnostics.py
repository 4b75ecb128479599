"""How single components relate to the label and to each other, by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import COMPONENTS, WEIGHTS
from .metrics import pearson, rank_metrics
from .quantiles import percentiles
from .scoring import fit_scaler, long_scores, mean_of, scaled, weighted


def unpivot(frame: DataFrame, columns: tuple[str, ...] = COMPONENTS, keep: tuple[str, ...] = ("period", "role", "label")) -> DataFrame:
    """(keep, component, x)."""
    return long_scores(frame, {c: F.col(c) for c in columns}, keep, "component").withColumnRenamed("score", "x")


def component_correlations(frame: DataFrame, columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(role, component_1, component_2, correlation) of all ordered pairs, from one aggregation."""
    pairs = [F.struct(F.lit(a).alias("component_1"), F.lit(b).alias("component_2"), pearson(F.col(a), F.col(b)).alias("correlation")) for a in columns for b in columns]
    return frame.groupBy("role").agg(F.array(*pairs).alias("p")).select("role", F.explode("p").alias("p")).select("role", "p.*")


def associations(frame: DataFrame, columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Correlation with the label, and average precision of a component and of its negative."""
    x = unpivot(frame, columns)
    corr = x.groupBy("role", "component").agg(pearson(F.col("x"), F.col("label").cast("double")).alias("event_correlation"))
    keys = ["role", "component"]
    ap = rank_metrics(x, keys, score="x").select(*keys, "average_precision")
    inverse = rank_metrics(x.withColumn("x", -F.col("x")), keys, score="x").select(*keys, F.col("average_precision").alias("inverse_average_precision"))
    return corr.join(ap, keys).join(inverse, keys)


def distributions(frame: DataFrame, columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    x, keys = unpivot(frame, columns).where("label IS NOT NULL").withColumnRenamed("label", "event"), ["role", "component", "event"]
    got = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.avg("x").alias("mean")).join(percentiles(x, keys, ("x",), [0.25, 0.5, 0.75]), keys, "left")
    return got.select("role", "component", "event", "observations", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))


def decile(rank: Column, n: Column, bins: int = 10) -> Column:
    """Bin of a rank from 1 to n as interpolated quantile edges cut it: ceil(bins * (rank - 1) / (n - 1)), at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.lit(bins) * (rank - 1) / (n - 1)).cast("int"))


def deciles(frame: DataFrame, columns: tuple[str, ...] = COMPONENTS, bins: int = 10) -> DataFrame:
    """Event rate and mean by decile; equal values are ranked by period. Needs two rows or more."""
    by = Window.partitionBy("role", "component")
    x = unpivot(frame, columns).withColumns({"r": F.row_number().over(by.orderBy("x", "period")), "n": F.count(F.lit(1)).over(by)}).where("n > 1")
    # In whole numbers: (bins * (r - 1) + n - 2) div (n - 1) is the ceiling.
    x = x.withColumn("decile", F.greatest(F.lit(1), F.expr(f"({bins} * (r - 1) + (n - 2)) div (n - 1)")).cast("int"))
    return x.groupBy("role", "component", "decile").agg(F.count(F.lit(1)).alias("observations"), F.avg("label").alias("event_rate"), F.avg("x").alias("mean_component"))


def saturation(frame: DataFrame, columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Share of each sample at or beyond the training percentiles."""
    s = fit_scaler(frame.where("role = 'train'"), columns)
    each = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("x"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in columns])
    x = frame.crossJoin(F.broadcast(s)).select("role", F.explode(each).alias("e")).select("role", "e.*")  # one row
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return x.groupBy("role", "component").agg(share(F.col("x") <= F.col("low")).alias("at_or_below_p05"), share(F.col("x") >= F.col("high")).alias("at_or_above_p95"), F.max("low").alias("training_p05"), F.max("high").alias("training_p95"))


def ablation_scores(columns: tuple[str, ...] = COMPONENTS, anchor: str = "contraction") -> dict[str, Column]:
    out: dict[str, Column] = {f"single_{c}": mean_of((c,)) for c in columns}
    out |= {f"{anchor}_plus_{c}": mean_of((anchor, c)) for c in columns if c != anchor}
    for left_out in columns:
        rest = {c: w for c, w in WEIGHTS.items() if c != left_out}
        out[f"without_{left_out}"] = weighted({c: w / sum(rest.values()) for c, w in rest.items()})
    return out


def ablation(frame: DataFrame, anchor: str = "contraction") -> DataFrame:
    """Average precision of single components, pairs with the anchor, and the heuristic without one."""
    s = long_scores(scaled(frame.where("role <> 'purge'"), COMPONENTS), ablation_scores(anchor=anchor), name="specification")
    ap = rank_metrics(s, ["specification", "role"])
    wide = ap.groupBy("specification").agg(*[F.max(F.when(F.col("role") == r, F.col("average_precision"))).alias(f"{r}_average_precision") for r in ("train", "test")])
    base = wide.where(F.col("specification") == f"single_{anchor}").select(F.col("test_average_precision").alias("base"))
    return wide.crossJoin(F.broadcast(base)).select("specification", "train_average_precision", "test_average_precision", (F.col("test_average_precision") - F.col("base")).alias("gain"))  # one row
