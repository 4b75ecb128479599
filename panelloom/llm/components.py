"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each u; combined before the shuffle, so that hubs do not gather."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    Each round rewires all neighbours of a node to its smallest one, first those above the node, then
    those below; the number of pairs does not grow, and the rounds grow with the logarithm of the diameter.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = materialise(pairs, "links")
    mark = _mark(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.where("v > u")
            .join(_least(both), "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = materialise(large, "stars")
        small = large.join(_least(large), "u").select(
            F.explode(
                F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("x")
        )
        pairs = materialise(small.select("x.u", "x.v").where("u != v").distinct(), "stars")
        before, mark = mark, _mark(pairs)
        if mark == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError("components did not settle")
