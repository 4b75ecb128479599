"""Correlations from blocks against plain ones, with gaps, constants, outliers, and more entities than a block has."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import network


def plain(x, window, least, threshold):
    """x[t, entity], row numbers from 1: (mean, density, pairs) of each row."""
    out = {}
    for t in range(window - 1, len(x)):
        w = x[t - window + 1 : t + 1]
        rho = []
        for i in range(w.shape[1]):
            for j in range(i + 1, w.shape[1]):
                both = ~np.isnan(w[:, i]) & ~np.isnan(w[:, j])
                a, b = w[both, i], w[both, j]
                if both.sum() >= least and np.ptp(a) > 0 and np.ptp(b) > 0:
                    rho.append(float(((a - a.mean()) * (b - b.mean())).sum() / np.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum())))
        if rho:
            out[t + 1] = (np.mean(rho), np.mean([r >= threshold for r in rho]), len(rho))
    return out


def cells(spark, x):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=t), t + 1, e, None if np.isnan(v) else float(v)) for t, row in enumerate(x) for e, v in enumerate(row)]
    return spark.createDataFrame(rows, "period date, n long, entity int, ret double")


def odd_values():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(150, 11)) + draw.normal(size=(150, 1))
    x[draw.random(x.shape) < 0.1] = np.nan
    x[40:90, 2] = 0.1  # constant for longer than a window
    x[:, 3] = x[:, 3] * 1e-9 + 5e3
    x[30, 4] = 1e9
    x[:, 5] = np.nan
    return x


@pytest.mark.parametrize(("block", "span"), [(4, 32), (3, 150), (32, None)])
def test_blocks_and_spans(spark, block, span):
    x = odd_values()
    want = {n: v for n, v in plain(x, 24, 15, 0.3).items()}
    got = {r.n: (r.total / r.n_pairs, r.n_dense / r.n_pairs, r.n_pairs) for r in network.pair_totals(cells(spark, x), "ret", 24, 15, 0.3, block, span).where("n >= 24").collect()}
    assert set(got) == set(want)
    for n, (mean, dense, k) in want.items():
        assert got[n][2] == k and got[n][0] == pytest.approx(mean, abs=1e-6) and got[n][1] == pytest.approx(dense)


def test_like_windows_of_pairs(spark):
    df = cells(spark, odd_values()[:, [0, 1, 2, 4, 6]])
    rho = network.pair_correlations(df, "ret", 30, 20).where("rho IS NOT NULL AND n >= 30").groupBy("n").agg(F.avg("rho").alias("m"), F.count("rho").alias("k")).collect()
    got = {r.n: r for r in network.network(df, "ret", 30, 0.3, 20).collect()}
    assert len(rho) > 100 and all(got[r.n].n_pairs == r.k and got[r.n].mean_correlation == pytest.approx(r.m, abs=1e-6) for r in rho)


def test_three_hundred_entities(spark):
    """44,850 pairs: ten blocks, no row for each pair and period."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(90, 300)) + 0.5 * draw.normal(size=(90, 1))
    got = {r.n: r for r in network.network(cells(spark, x), "ret", 60, 0.3).collect()}
    assert sorted(got) == list(range(60, 91)) and all(r.n_pairs == 44850 for r in got.values())
    for n in (60, 75, 90):
        c = np.corrcoef(x[n - 60 : n].T)[np.triu_indices(300, 1)]
        assert got[n].mean_correlation == pytest.approx(c.mean()) and got[n].density == pytest.approx((c >= 0.3).mean())
