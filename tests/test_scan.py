"""Windows over ranges of the order against plain windows, with values that straddle the ranges' edges."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.operators import episodes, metrics, panel, scan, timeindex
from panelloom.operators.scan import Ordered

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    flags = [draw.random() < 0.7 for _ in range(240)]
    return spark.createDataFrame([(DAY + dt.timedelta(days=k + (k > 100) * 3), float(draw.randrange(-5, 9)) if k % 11 else None, f, k) for k, f in enumerate(flags)], "period date, value double, flag boolean, k int").repartition(5).cache()


@pytest.mark.parametrize("size", [30, 7, 1000])
def test_numbers_sums_and_frames(rows, size):
    w = Window.orderBy("period")
    make = lambda v: {"a": F.lag("value", 3).over(v), "b": F.sum("value").over(v.rowsBetween(-9, 0)), "c": F.stddev_samp("value").over(v.rowsBetween(1, 12)), "d": F.lead("k", 12).over(v)}
    want = rows.withColumns(make(w) | {"n": F.row_number().over(w), "s": F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))}).orderBy("k").collect()
    o = Ordered.of(rows, ["period"], size)
    assert o.parts == -(-240 // size)
    got = o.frames(9, 12, make).sums({"s": F.col("value")}).result("n").orderBy("k").collect()
    assert len(got) == len(want)
    for g, x in zip(got, want, strict=True):
        assert (g.k, g.n, g.a, g.d) == (x.k, x.n, x.a, x.d) and g.b == pytest.approx(x.b) and g.s == pytest.approx(x.s or 0.0) and (g.c == pytest.approx(x.c) or g.c is x.c)


@pytest.mark.parametrize("size", [30, 3])
def test_runs_straddle_ranges(rows, size):
    plain, run, before = {}, 0, False
    for r in sorted(rows.collect(), key=lambda r: r.period):
        run += r.flag and not before
        before = r.flag
        if r.flag:
            plain[r.k] = run
    got = scan.runs(rows, ["period"], F.col("flag"), "run", size)
    assert {r.k: r.run for r in got.collect()} == plain
    whole = scan.runs(rows, ["period"], F.lit(True), "run", size).select("run").distinct().collect()
    assert [r.run for r in whole] == [1]  # one run over all ranges


def test_flow_and_index_over_ranges(rows):
    assert sorted(panel.series_flow(rows.select("period", "value"), 30).collect()) == sorted(panel.series_flow(rows.select("period", "value")).collect())
    assert sorted(timeindex.dense_index(rows, rows=30).collect()) == sorted(timeindex.dense_index(rows).collect())


def test_empty_and_single(spark, rows):
    for n in (0, 1):
        few = rows.orderBy("k").limit(n)
        assert scan.numbered(few, ["period"], "i", 0, 30).count() == n and scan.runs(few, ["period"], F.lit(True), "r", 30).count() == n


def test_rank_metrics_of_one_large_key(spark):
    """10^6 distinct scores of one key over eight ranges, and a few of another, as numpy has them."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("big").alias("key"), ((F.col("id") * 7919 + 13) % n / 8).alias("score"), (F.xxhash64("id") % 5 == 0).cast("int").alias("label"))
    small = spark.createDataFrame([(None, 0.5, 1), (None, 0.5, 0), (None, 0.2, 1), ("none", 0.1, 0)], "key string, score double, label int")
    both = df.unionByName(small)
    got = {r.key: r for r in metrics.rank_metrics(both, ["key"], rows=125_001).collect()}
    order = df.orderBy(F.desc("score")).select("label").toPandas()["label"].to_numpy()
    tp = np.cumsum(order)
    pos = int(tp[-1])
    ap = float((order * tp / np.arange(1, n + 1)).sum() / pos)
    ranks = float(((n - np.arange(n)) * order).sum())
    auc = (ranks - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert (got["big"].observations, got["big"].events) == (n, pos)
    assert got["big"].average_precision == pytest.approx(ap, rel=1e-9) and got["big"].roc_auc == pytest.approx(auc, rel=1e-9)
    assert got[None].average_precision == pytest.approx((0.5 + 2 / 3) / 2) and got[None].roc_auc == pytest.approx(0.25) and got["none"].average_precision is None
    plain = {r.key: r for r in metrics.rank_metrics(both, ["key"]).collect()}
    assert all(plain[k].average_precision == pytest.approx(got[k].average_precision) and plain[k].roc_auc == pytest.approx(got[k].roc_auc) for k in (None, "big"))


def test_episode_module_uses_ranges():
    assert episodes.runs is scan.runs and math.ceil(240 / 30) == 8
