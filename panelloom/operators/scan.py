"""Windows over all rows in order, in two passes over ranges of the order.

A window without a partition would run in one task. Here rows are dealt to ranges of their order, each range gets its
sums and its number of rows, and what comes before a range is carried into it: an offset for row numbers and running sums,
copies of the nearest rows of its neighbours for frames of a bounded number of rows. Only a row for each range (`ROWS` rows
of data) is ever gathered. Up to ROWS rows are one range, for which the plain window is the same thing.

The order must tell rows apart where the result depends on it; rows of equal order stay in one range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.stage import staged

ROWS = 1_000_000
_OWN = ("_part", "_i", "_first", "_end")


@dataclass(frozen=True)
class Ordered:
    """rows with their range _part, their position _i from 0, and the positions _first to _end (exclusive) of their range."""

    rows: DataFrame
    spans: DataFrame
    parts: int

    @classmethod
    def of(cls, df: DataFrame, order: list[str], rows: int = ROWS) -> Ordered:
        base = staged(df, "ordered")
        parts = max(1, -(-base.count() // rows))  # from the files' footers
        if parts > 1:
            # Written, as the edges of ranges come from a sample and must not move between the passes.
            base = staged(base.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
        else:
            base = base.withColumn("_part", F.lit(0))
        each = base.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct(*order)).alias("_low"))
        end = F.sum("_size").over(Window.orderBy("_low"))  # a row for each range
        spans = each.select("_part", (end - F.col("_size")).alias("_first"), end.alias("_end"))
        local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
        return cls(base.join(F.broadcast(spans), "_part").withColumn("_i", local + F.col("_first")), spans, parts)

    def frames(self, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]]) -> Ordered:
        """New columns by a window of rows that reaches at most `before` rows back and `after` rows on."""
        w = Window.partitionBy("_part").orderBy("_i")
        if self.parts == 1:
            return Ordered(self.rows.withColumns(make(w)), self.spans, 1)
        edge = self.rows.where((F.col("_i") >= F.col("_end") - before) | (F.col("_i") < F.col("_first") + after))
        to = self.spans.select(F.col("_part").alias("_to"), F.col("_first").alias("_a"), F.col("_end").alias("_b"))
        i = F.col("_i")
        near = ((i < F.col("_a")) & (i >= F.col("_a") - before)) | ((i >= F.col("_b")) & (i < F.col("_b") + after))
        lent = edge.join(F.broadcast(to), near).withColumn("_part", F.col("_to")).drop("_to", "_a", "_b")  # a row for each range
        both = self.rows.withColumn("_lent", F.lit(False)).unionByName(lent.withColumn("_lent", F.lit(True)))
        return Ordered(both.withColumns(make(w)).where("NOT _lent").drop("_lent"), self.spans, self.parts)

    def sums(self, columns: dict[str, Column]) -> Ordered:
        """New columns: sums of values over all rows up to and including each; nulls count as nothing."""
        w = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.rows.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in columns.items()})
        rows = rows.withColumns({n: F.sum(f"_v_{n}").over(w) for n in columns})
        if self.parts > 1:
            each = rows.groupBy("_part", "_first").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in columns])
            so_far = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
            carried = each.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(so_far), F.lit(0)).alias(f"_c_{n}") for n in columns])
            rows = rows.join(F.broadcast(carried), "_part").withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in columns}).drop(*[f"_c_{n}" for n in columns])
        return Ordered(rows.drop(*[f"_v_{n}" for n in columns]), self.spans, self.parts)

    def result(self, number: str | None = None, start: int = 1) -> DataFrame:
        """The rows without what this class added, but on demand with their number."""
        out = self.rows if number is None else self.rows.withColumn(number, (F.col("_i") + start).cast("long"))
        return out.drop(*_OWN)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1, rows: int = ROWS) -> DataFrame:
    return Ordered.of(df, order, rows).result(name, start)


def framed(df: DataFrame, order: list[str], before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], rows: int = ROWS) -> DataFrame:
    return Ordered.of(df, order, rows).frames(before, after, make).result()


def runs(df: DataFrame, order: list[str], flag: Column, name: str, rows: int = ROWS) -> DataFrame:
    """Rows where flag holds, with the number of their run from 1: rows next to each other in order belong together."""
    o = Ordered.of(df.withColumn("_on", F.coalesce(flag, F.lit(False))), order, rows)
    o = o.frames(1, 0, lambda w: {"_new": (F.col("_on") & ~F.lag("_on", 1, False).over(w)).cast("long")})
    return o.sums({name: F.col("_new")}).result().where("_on").drop("_on", "_new")


def below_and_all(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], rows: int = ROWS) -> DataFrame:
    """df with sums of columns within each key: `<name>_below` over the rows before this one in order, `<name>_all` over all.

    values: names and the columns that they sum; order must tell the rows of a key apart. Above `rows` rows sums come from ranges of
    (keys, order), so that one key may have any number of rows; up to that, from a window for each key.
    """
    o = Ordered.of(df, [*keys, *order], rows)
    if o.parts == 1:
        whole = Window.partitionBy(*keys)
        before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return o.result().withColumns({f"{n}_below": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in values.items()} | {f"{n}_all": F.sum(c).over(whole) for n, c in values.items()})
    g = o.sums({f"{n}_below": F.col(c) for n, c in values.items()}).result().withColumns({f"{n}_below": F.col(f"{n}_below") - F.col(c) for n, c in values.items()})
    each = g.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[F.min(f"{n}_below").alias(f"_from_{n}") for n in values], *[F.sum(c).alias(f"{n}_all") for n, c in values.items()])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return g.join(each, same).withColumns({f"{n}_below": F.col(f"{n}_below") - F.col(f"_from_{n}") for n in values}).drop(*[f"_k_{k}" for k in keys], *[f"_from_{n}" for n in values])
