"""Exact percentiles from ranges against the aggregate that holds whole groups."""

import pytest
from pyspark.sql import functions as F

from panelloom.operators.quantiles import percentiles

AT = [0.0, 0.05, 1 / 3, 0.5, 0.975, 1.0]


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_like_the_aggregate(spark, rows):
    df = spark.createDataFrame([(k % 3 if k % 3 else None, float((k * 37) % 91), float(k % 2) if k % 5 else None) for k in range(200)] + [(7, None, 1.5), (8, 4.0, None)], "g int, x double, y double")
    got = {(r.g, r.column): r.q for r in percentiles(df, ["g"], ("x", "y"), AT, rows).collect()}
    want = {}
    for c in ("x", "y"):
        want |= {(r.g, c): r.q for r in df.groupBy("g").agg(F.percentile(c, F.array(*[F.lit(p) for p in AT])).alias("q")).collect() if r.q is not None}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_a_million_distinct_values(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(((F.col("id") * 7919 + 5) % 1_000_000 / 16).alias("x"))
    got = percentiles(df, [], ("x",), AT, 130_000).first().q
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in AT])).alias("q")).first().q
    assert got == pytest.approx(want, rel=1e-12)


def test_no_values(spark):
    assert percentiles(spark.createDataFrame([], "x double"), [], ("x",), AT).count() == 0


def test_many_shares(spark):
    """A row meets only the shares near its ranks; ties, groups of one row and unordered shares lose none."""
    at = [k / 300 for k in range(301)][::-1]
    df = spark.createDataFrame([(0, float(k // 40) if k % 3 else float(k)) for k in range(1000)] + [(1, 5.0), (2, 1.0), (2, 2.0)], "g int, x double")
    got = {r.g: r.q for r in percentiles(df, ["g"], ("x",), at).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in at])).alias("q")).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
