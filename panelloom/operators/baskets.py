"""Returns of a basket of entities under five weightings, one row for each period.

Cells come from a scaffold (entity, category, period, n, value, ret); a return that is missing leaves its
entity out of a period's sums. A period with fewer than `min_active` returns has a null basket return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip


def cells(wide: DataFrame, bound: float = 0.35) -> DataFrame:
    """Clipped returns, and the value on the row before as a weight."""
    before = Window.partitionBy("entity").orderBy("n")
    return wide.select("entity", "category", "period", "n", "value", clip(F.col("log_return"), -bound, bound).alias("ret"), F.lag("value").over(before).alias("lagged"))


def _gate(c: Column, min_active: int) -> Column:
    return F.when(F.count("ret") >= min_active, c)


def _weighted(weight: Column) -> Column:
    both = weight.isNotNull() & F.col("ret").isNotNull()
    return F.try_divide(F.sum(F.when(both, weight * F.col("ret"))), F.sum(F.when(both, weight)))


def equal_weight(c: DataFrame, min_active: int = 6) -> DataFrame:
    return c.groupBy("period", "n").agg(_gate(F.avg("ret"), min_active).alias("equal_weight"))


def lagged_weight(c: DataFrame, min_active: int = 6) -> DataFrame:
    return c.groupBy("period", "n").agg(_gate(_weighted(F.col("lagged")), min_active).alias("lagged_weight"))


def cap_weights(c: DataFrame, cap: float = 0.25) -> DataFrame:
    """c with `capped`: shares of positive lagged values with none above cap, the excess spread over the rest.

    With k entities at the cap the others share 1 - k * cap by value; the least k for which the largest of
    the others stays below the cap is the solution.
    """
    ok = F.when((F.col("lagged") > 0) & F.col("ret").isNotNull(), F.col("lagged"))
    c = c.withColumn("x", ok)
    down = Window.partitionBy("period").orderBy(F.desc_nulls_last("x"), "entity")
    c = c.withColumn("k", F.row_number().over(down) - 1).withColumn("rest", F.sum("x").over(down.rowsBetween(0, Window.unboundedFollowing)))
    scale = F.try_divide(F.lit(1.0) - F.col("k") * cap, F.col("rest"))
    c = c.withColumn("scale", F.when(F.col("x").isNotNull(), scale))
    day = Window.partitionBy("period")
    c = c.withColumn("stop", F.min(F.when(F.col("x") * F.col("scale") <= cap + 1e-12, F.col("k"))).over(day))
    c = c.withColumn("unit", F.max(F.when(F.col("k") == F.col("stop"), F.col("scale"))).over(day))
    capped = F.when(F.col("x").isNull(), None).when(F.col("stop").isNull() | (F.col("k") < F.col("stop")), F.lit(cap)).otherwise(F.col("x") * F.col("unit"))
    return c.withColumn("capped", capped).drop("x", "k", "rest", "scale", "stop", "unit")


def capped_weight(c: DataFrame, cap: float = 0.25, min_active: int = 6) -> DataFrame:
    return cap_weights(c, cap).groupBy("period", "n").agg(_gate(_weighted(F.col("capped")), min_active).alias("capped_weight"))


def category_weight(c: DataFrame, min_active: int = 6) -> DataFrame:
    """Each category present weighs alike, and its entities alike within it."""
    by = c.groupBy("period", "n", "category").agg(F.avg("ret").alias("m"), F.count("ret").alias("k"))
    return by.groupBy("period", "n").agg(F.when(F.coalesce(F.sum("k"), F.lit(0)) >= min_active, F.avg("m")).alias("category_weight"))


def common_weight(c: DataFrame, members: DataFrame) -> DataFrame:
    """Mean over the entities of the common history, on periods where all of them return."""
    own = c.join(members.where("member").select("entity"), "entity")
    size = members.agg(F.count_if("member").alias("size"))
    got = c.select("period", "n").distinct().join(own.groupBy("period").agg(F.avg("ret").alias("m"), F.count("ret").alias("k")), "period", "left")
    return got.crossJoin(F.broadcast(size)).select("period", "n", F.when((F.col("size") > 0) & (F.col("k") == F.col("size")), F.col("m")).alias("common_history"))  # one row


def all_baskets(c: DataFrame, members: DataFrame, cap: float = 0.25, min_active: int = 6) -> DataFrame:
    out = equal_weight(c, min_active)
    for other in (lagged_weight(c, min_active), capped_weight(c, cap, min_active), category_weight(c, min_active), common_weight(c, members)):
        out = out.join(other, ["period", "n"])
    return out


BASKETS = ("equal_weight", "lagged_weight", "capped_weight", "category_weight", "common_history")
