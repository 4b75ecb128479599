"""Exact percentiles of groups of any size.

The percentile aggregate holds all distinct values of a group in one buffer. Here distinct values are counted, their ranks
come from ranges of the order (scan.py), and only the rows that hold a wanted rank go on.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import ROWS, below_and_all


def percentiles(df: DataFrame, keys: list[str], columns: tuple[str, ...], at: list[float], rows: int = ROWS) -> DataFrame:
    """(keys, column, q): for each group and column the values at the shares `at` of its ranks, interpolated; nulls don't count.

    A group or column without any value has no row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns]))
    long = df.select(*keys, each.alias("_e")).select(*keys, "_e.column", "_e._v").where("_v IS NOT NULL")
    counted = long.groupBy(*keys, "column", "_v").agg(F.count(F.lit(1)).alias("_n"))
    own = [*keys, "column"]
    g = below_and_all(counted, own, ["_v"], {"_r": "_n"}, rows)
    # Ranks from _r_below to _r_below + _n - 1 have this value; a share asks for the ranks on both sides of its position.
    first, end = F.col("_r_below"), F.col("_r_below") + F.col("_n")
    place = lambda p: p * (F.col("_r_all") - 1)
    holds = lambda r: (r >= first) & (r < end)
    points = sorted((float(p), k) for k, p in enumerate(at))
    # A look-up in a grid of shares leaves a row the few shares that may ask for it: as a rule none, so that rows don't meet all shares.
    cells = max(64, 16 * len(at))
    below = F.expr(f"array({', '.join(str(bisect_left(points, (c / cells,))) for c in range(cells + 1))}, {len(at)})")
    most, count = F.greatest(F.col("_r_all") - 1, F.lit(1)), lambda c: F.get(below, F.least(F.greatest(c, F.lit(0)), F.lit(cells + 1)).cast("int"))
    g = g.withColumns({"_a": count(F.floor((first - 1) / most * cells) - 1), "_b": count(F.ceil(end / most * cells) + 2)}).where("_b > _a")
    few = F.slice(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for p, k in points]), F.col("_a") + 1, F.col("_b") - F.col("_a"))
    asked = F.filter(few, lambda x: holds(F.floor(place(x["p"]))) | holds(F.ceil(place(x["p"]))))
    hit = g.select(*own, "_v", "_r_below", "_n", "_r_all", F.explode(asked).alias("x")).withColumn("_at", place(F.col("x.p")))
    low, high = F.floor("_at"), F.ceil("_at")
    two = hit.groupBy(*own, F.col("x.k").alias("k")).agg(F.max("_at").alias("_at"), F.max(F.when(holds(low), F.col("_v"))).alias("a"), F.max(F.when(holds(high), F.col("_v"))).alias("b"))
    value = F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise((high - F.col("_at")) * F.col("a") + (F.col("_at") - low) * F.col("b"))
    return two.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]).alias("q"))  # an entry for each share
