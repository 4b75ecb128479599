"""Missing data, gates and windows, on fixtures small enough to work out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelloom.functions.scalar import clip, nearest_utc_day, safe_ln, utc_day
from panelloom.operators import baskets, network, panel, timeindex

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_clean_prefers_the_latest_valid(spark):
    rows = [("a", day(0), 1, 50.0), ("a", day(0), 2, 3.0), ("b", day(0), 5, 20.0), ("b", day(0), 5, 30.0), ("c", day(0), 1, None), ("d", dt.date(2019, 1, 1), 1, 99.0)]
    raw = frame(spark, rows, "entity string, period date, observed_at long, value double")
    got = {r.entity: r.value for r in panel.clean_latest(raw, ["entity", "period"], "observed_at", 10.0, "2020-01-01").collect()}
    assert got == {"a": 50.0, "b": 30.0}


def test_returns_need_adjacent_days(spark):
    rows = [("a", "x", day(k), v) for k, v in ((0, 10.0), (1, 20.0), (3, 40.0), (4, 0.0), (5, 5.0), (6, -1.0), (7, None), (8, 80.0), (9, 40.0))]
    got = panel.with_returns(frame(spark, rows, "entity string, category string, period date, value double")).orderBy("period").collect()
    assert [r.log_return for r in got] == [None, pytest.approx(math.log(2)), None, None, None, None, None, None, pytest.approx(math.log(0.5))]
    assert got[2].drawdown == 0 and got[-1].drawdown == pytest.approx(-0.5)
    many = frame(spark, [("a", "x", day(k), float(100 - k)) for k in range(12)], "entity string, category string, period date, value double")
    last = panel.with_returns(many).orderBy(F.desc("period")).first()
    assert last.drawdown == pytest.approx(89 / 96 - 1)  # eight rows, the current one among them


def test_gate_counts_returns(spark):
    rows = [(f"e{i}", "x", day(k), 10.0 + i + k) for i in range(6) for k in range(3) if not (i == 5 and k == 2)]
    ret = panel.with_returns(frame(spark, rows, "entity string, category string, period date, value double"))
    flows = panel.series_flow(frame(spark, [(day(0), 1.0), (day(1), 2.0), (day(3), 4.0)], "period date, value double"))
    got = panel.system_daily(ret, flows).collect()
    assert [(r.period, r.n_active) for r in got] == [(day(1), 6)] and got[0].series_flow == pytest.approx(math.log(2))
    assert [r.log_flow for r in flows.orderBy("period").collect()] == [None, pytest.approx(math.log(2)), None]


def test_scalars(spark):
    df = frame(spark, [(None,), (-2.0,), (0.0,), (9.0,)], "x double").select(clip(F.col("x"), -1.0, 1.0).alias("c"), safe_ln(F.col("x")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [(None, None), (-1.0, None), (0.0, None), (1.0, pytest.approx(math.log(9)))]
    late = frame(spark, [(86400 - 5,)], "s long").select(utc_day(F.col("s")).alias("a"), nearest_utc_day(F.col("s")).alias("b")).first()
    assert (late.a, late.b) == (dt.date(1970, 1, 1), dt.date(1970, 1, 2))


def test_forward_sum_and_label(spark):
    rows = [(k, 0.01 if k != 4 else None) for k in range(1, 16)]
    df = frame(spark, rows, "n int, r double").withColumn("f", timeindex.forward_sum("r", 7)).withColumn("y", timeindex.stress_label(F.col("f"), math.log(0.95)))
    got = {r.n: (r.f, r.y) for r in df.collect()}
    assert all(got[k] == (None, None) for k in (1, 2, 3, *range(9, 16))) and got[8] == (pytest.approx(0.07), 0)
    edge = frame(spark, [(1, None), (2, math.log(0.95))], "n int, r double").withColumn("f", timeindex.forward_sum("r", 1))
    assert edge.select(timeindex.stress_label(F.col("f"), math.log(0.95))).first()[0] == 1


def plain_cap(values, cap):
    """Water-filling step by step."""
    free, out = dict(values), {}
    while free:
        rest = 1 - cap * len(out)
        total = sum(free.values())
        over = [k for k, v in free.items() if v * rest / total > cap + 1e-12]
        if not over:
            return out | {k: v * rest / total for k, v in free.items()}
        for k in over:
            out[k] = cap
            del free[k]
    return out


@pytest.mark.parametrize("values", [[1000, 1, 1, 1, 1, 1], [5, 5, 5], [50, 40, 30, 20, 10, 5, 2, 1], [3, None, 0, -2, 7, 8, 9, 10], [1]])
def test_cap_weights(spark, values):
    c = frame(spark, [(day(0), 1, f"e{i}", "x", float(v) if v is not None else None, 0.1) for i, v in enumerate(values)], "period date, n int, entity string, category string, lagged double, ret double")
    got = {r.entity: r.capped for r in baskets.cap_weights(c, 0.25).collect() if r.capped is not None}
    want = plain_cap({f"e{i}": float(v) for i, v in enumerate(values) if v is not None and v > 0}, 0.25)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_constant_pairs_are_dropped(spark):
    rows = [(day(k), k + 1, e, v) for k in range(25) for e, v in (("a", math.sin(k)), ("b", 0.5), ("c", math.sin(k) * 2))]
    cells = frame(spark, rows, "period date, n int, entity string, ret double")
    last = network.network(cells, "ret", 20, 0.5).orderBy(F.desc("n")).first()
    assert (last.n_active, last.n_pairs) == (3, 1) and last.mean_correlation == pytest.approx(1.0) and last.density == 1.0
    assert {(r.src, r.dst) for r in network.latest_edges(cells, "ret", 20, 0.5).collect()} == {("a", "c"), ("c", "a")}


def test_residuals_use_the_past_and_own_moments(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    f, y = draw.normal(size=130), draw.normal(size=130)
    gap = {20, 50, 51}
    cells = frame(spark, [(day(k), k + 1, "a", None if k in gap else float(y[k])) for k in range(130)], "period date, n int, entity string, ret double")
    factor = frame(spark, [(day(k), float(f[k])) for k in range(130)], "period date, factor_return double")
    got = {r.n: r for r in network.residuals(cells, factor).collect()}
    assert got[93].beta is None and got[94].beta is not None  # ninety joint rows before it
    k = 120
    own = [i for i in range(k) if i not in gap]
    beta = np.cov(y[own], f[own])[0, 1] / np.var(f[:k], ddof=1)
    alpha = y[own].mean() - beta * f[:k].mean()
    assert got[k + 1].beta == pytest.approx(beta) and got[k + 1].residual == pytest.approx(y[k] - alpha - beta * f[k])


def test_factor_with_a_gap_is_an_error(spark):
    with pytest.raises(ValueError, match="2024-01-02"):
        panel.factor_control(frame(spark, [(day(0), 1.0), (day(2), 2.0)], "period date, level double"))
