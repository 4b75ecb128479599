"""Rolling correlation networks, and returns without a factor's part.

A network of all pairs is computed from blocks: a group holds two blocks of entities over one span of periods, the running
sums of all their pairs' moments are vectors, and a window's moments are the difference of two. What leaves a group is a row for each
period, with the sum and counts of its pairs' correlations, so no pair has a row for each period.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gated, rows_of
from .scan import numbered

#: Entities of a block.
BLOCK = 32


def needed(window: int) -> int:
    """Joint observations that a correlation over `window` rows asks for."""
    return max(20, math.ceil(0.75 * window))


def _pairs(cells: DataFrame, value: str) -> DataFrame:
    """(n, src, dst, x, y) of all pairs of entities src < dst, null unless both are there."""
    a = cells.select("n", F.col("entity").alias("src"), F.col(value).alias("x"))
    b = cells.select("n", F.col("entity").alias("dst"), F.col(value).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    # Pairs stay within a period: entities are few beside periods, and windows then run pair by pair.
    return a.join(b, "n").where("src < dst").select("n", "src", "dst", F.when(both, F.col("x")).alias("x"), F.when(both, F.col("y")).alias("y"))


def pair_correlations(cells: DataFrame, value: str, window: int, min_obs: int | None = None) -> DataFrame:
    """(n, src, dst, rho) for every pair and row; null below min_obs joint observations or without variance."""
    k = needed(window) if min_obs is None else min_obs
    w = rows_of(["src", "dst"], "n", 1 - window, 0)
    rho = F.try_divide(F.covar_samp("x", "y").over(w), F.stddev_samp("x").over(w) * F.stddev_samp("y").over(w))
    return _pairs(cells, value).select("n", "src", "dst", F.when(F.count("x").over(w) >= k, rho).alias("rho"))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlations of rows of windows, NaN where missing: two passes, so that no rounding of large sums enters."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = np.maximum(both.sum(axis=1), 1)
    dx, dy = (np.where(both, v - (np.where(both, v, 0.0).sum(axis=1) / n)[:, None], 0.0) for v in (x, y))
    flat = np.zeros(len(x), bool)
    for v in (x, y):
        flat |= np.where(both, v, -np.inf).max(axis=1) == np.where(both, v, np.inf).min(axis=1)
    size = np.sqrt((dx * dx).sum(axis=1)) * np.sqrt((dy * dy).sum(axis=1))
    return np.where(flat | (size == 0), np.nan, (dx * dy).sum(axis=1) / np.where(size == 0, 1.0, size))


def block_correlations(x: np.ndarray, y: np.ndarray, window: int, least: int) -> np.ndarray:
    """rho[t, i, j] of x[:, i] and y[:, j] over the `window` rows that end at row window - 1 + t; NaN where there is none.

    Values are centred by column, sums run within the rows given, and windows whose variance is small beside these
    sums are computed again from their values.
    """
    mx, my = ~np.isnan(x), ~np.isnan(y)
    zero = lambda v, m: np.where(m, v - np.divide(np.where(m, v, 0.0).sum(axis=0), np.maximum(m.sum(axis=0), 1)), 0.0)
    a, b = zero(x, mx), zero(y, my)

    def moved(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.concatenate([np.zeros((1, u.shape[1], v.shape[1])), np.cumsum(u[:, :, None] * v[:, None, :], axis=0)])
        return run[window:] - run[:-window], run[-1]

    n = np.rint(moved(mx.astype(float), my.astype(float))[0])
    some = np.maximum(n, 1.0)
    (sx, _), (sy, _), (sxy, _), (sxx, wx), (syy, wy) = moved(a, my), moved(mx, b), moved(a, b), moved(a * a, my), moved(mx, b * b)
    vx, vy = sxx - sx * sx / some, syy - sy * sy / some
    enough = n >= max(least, 2)
    doubt = enough & ((vx <= 1e-7 * wx) | (vy <= 1e-7 * wy))
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = np.where(enough, (sxy - sx * sy / some) / np.sqrt(vx * vy), np.nan)
    t, i, j = np.nonzero(doubt)
    for k in range(0, len(t), 4096):
        at = t[k : k + 4096, None] + np.arange(window)
        rho[t[k : k + 4096], i[k : k + 4096], j[k : k + 4096]] = _exact(x[at, i[k : k + 4096, None]], y[at, j[k : k + 4096, None]])
    return rho


def pair_totals(cells: DataFrame, value: str, window: int, least: int, threshold: float, block: int = BLOCK, span: int | None = None) -> DataFrame:
    """(n, total, n_pairs, n_dense): for each row of time the sum and number of its pairs' correlations, and how many reach the threshold.

    A value goes to one group for each block, rather than to one for each entity, and to the next span of periods too where windows
    reach into it; a group has at most 2 x block x (span + window) values.
    """
    span = span or max(256, 4 * window)
    number = numbered(cells.select("entity").distinct(), ["entity"], "_e", 0)
    last = number.agg(F.max("_e").alias("_last"))
    rows = cells.where(F.col(value).isNotNull()).select("entity", "n", F.col(value).cast("double").alias("_v")).join(number, "entity").crossJoin(F.broadcast(last))  # one row
    spans = F.when(F.col("n") % span > span - window, F.array(F.floor(F.col("n") / span), F.floor(F.col("n") / span) + 1)).otherwise(F.array(F.floor(F.col("n") / span)))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / block))
    rows = rows.withColumn("_b", F.floor(F.col("_e") / block)).withColumn("_span", F.explode(spans)).withColumn("_o", F.explode(blocks))
    rows = rows.select("n", "_e", "_v", "_span", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def totals(key, pdf):
        import pandas as pd

        k, i, j = (int(v) for v in key)
        first = k * span - window + 1
        t, e, v = (pdf["n"].to_numpy() - first).astype(int), pdf["_e"].to_numpy(), pdf["_v"].to_numpy()
        wide = int((e % block).max()) + 1  # a block that is not full takes the work of its own entities only

        def filled(b: int) -> np.ndarray:
            out, at = np.full((span + window - 1, wide), np.nan), e // block == b
            out[t[at], (e[at] - b * block).astype(int)] = v[at]
            return out

        rho = block_correlations(x := filled(i), x if i == j else filled(j), window, least)
        if i == j:
            rho = np.where(np.triu(np.ones((wide, wide), bool), 1), rho, np.nan)
        n = (~np.isnan(rho)).sum(axis=(1, 2))
        out = pd.DataFrame({"n": np.arange(len(n)) + k * span, "total": np.nansum(rho, axis=(1, 2)), "n_pairs": n, "n_dense": (rho >= threshold).sum(axis=(1, 2))})
        return out[n > 0]

    each = rows.groupBy("_span", "_i", "_j").applyInPandas(totals, "n long, total double, n_pairs long, n_dense long")
    end = cells.agg(F.max("n").alias("_end"))  # windows of the last span may reach beyond the rows that there are
    each = each.crossJoin(F.broadcast(end)).where("n <= _end")  # one row
    return each.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("total", "n_pairs", "n_dense")])


def network(cells: DataFrame, value: str, window: int = 60, threshold: float = 0.45, min_obs: int | None = None, prefix: str = "") -> DataFrame:
    """One row for each period from the first full window on: mean pair correlation, density, active entities, pairs."""
    k = needed(window) if min_obs is None else min_obs
    w = rows_of(["entity"], "n", 1 - window, 0)
    days = cells.withColumn("c", F.count(value).over(w)).groupBy("period", "n").agg(F.count_if(F.col("c") >= k).alias("n_active")).where(F.col("n") >= window)
    stats = pair_totals(cells, value, window, k, threshold).select("n", (F.col("total") / F.col("n_pairs")).alias("mean_correlation"), (F.col("n_dense") / F.col("n_pairs")).alias("density"), "n_pairs")
    out = days.join(stats, "n", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return out.select("period", "n", *[F.col(c).alias(prefix + c) for c in ("mean_correlation", "density", "n_active", "n_pairs")])


def latest_edges(cells: DataFrame, value: str, window: int = 60, threshold: float = 0.45, min_obs: int | None = None) -> DataFrame:
    """(src, dst, rho) in both directions over the last `window` rows, where rho reaches the threshold."""
    return latest_edges_of(cells, value, [(window, threshold)], min_obs).select("src", "dst", "rho")


def latest_edges_of(cells: DataFrame, value: str, kinds: list[tuple[int, float]], min_obs: int | None = None) -> DataFrame:
    """(window, threshold, src, dst, rho): latest_edges of several windows and thresholds, in one pass over the longest."""
    windows = sorted({w for w, _ in kinds})
    last = cells.agg(F.max("n").alias("last"))
    tail = cells.crossJoin(F.broadcast(last)).where(F.col("n") > F.col("last") - windows[-1])  # one row
    pairs = _pairs(tail.select("n", "entity", value), value).crossJoin(F.broadcast(last))  # one row
    rho = []
    for w in windows:
        x, y = (F.when(F.col("n") > F.col("last") - w, F.col(c)) for c in "xy")
        r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
        rho.append(F.when(F.count(x) >= (needed(w) if min_obs is None else min_obs), r).alias(f"rho_{w}"))
    each = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(t).alias("threshold"), F.col(f"rho_{w}").alias("rho")) for w, t in kinds])
    got = pairs.groupBy("src", "dst").agg(*rho).select("src", "dst", F.explode(each).alias("x")).select("x.window", "x.threshold", "src", "dst", "x.rho").where("rho >= threshold")
    return got.unionByName(got.select("window", "threshold", F.col("dst").alias("src"), F.col("src").alias("dst"), "rho"))


def residuals(cells: DataFrame, factor: DataFrame, value: str = "ret", window: int = 180, min_obs: int = 90) -> DataFrame:
    """cells with factor_return, beta, alpha and residual; moments come from the `window` rows before each row.

    The covariance is over joint rows, the variance and mean of the factor and the mean of the entity over their
    own; each needs min_obs. With gaps this is no least-squares fit.
    """
    f = cells.join(factor.select("period", "factor_return"), "period", "left")
    w = rows_of(["entity"], "n", -window, -1)
    x, y = F.col("factor_return"), F.col(value)
    cov = gated(F.covar_samp(y, x), F.when(y.isNotNull(), x), min_obs, w)
    var, mean_x, mean_y = gated(F.var_samp(x), x, min_obs, w), gated(F.avg(x), x, min_obs, w), gated(F.avg(y), y, min_obs, w)
    f = f.withColumns({"_var": var, "_cov": cov, "_mx": mean_x, "_my": mean_y})
    f = f.withColumn("beta", F.when(F.col("_var") != 0, F.try_divide("_cov", "_var")))
    f = f.withColumn("alpha", F.col("_my") - F.col("beta") * F.col("_mx"))
    return f.withColumn("residual", y - (F.col("alpha") + F.col("beta") * x)).drop("_var", "_cov", "_mx", "_my")


def factor_summary(res: DataFrame, value: str = "ret") -> DataFrame:
    """For each entity: rows, correlation with the factor, median beta, and variance left."""
    full = F.col(value).isNotNull() & F.col("factor_return").isNotNull() & F.col("residual").isNotNull()
    y, x, e = (F.when(full, F.col(c)) for c in (value, "factor_return", "residual"))
    return res.groupBy("entity").agg(
        F.count(e).alias("n_obs"),
        F.try_divide(F.covar_samp(y, x), F.stddev_samp(y) * F.stddev_samp(x)).alias("raw_correlation"),
        F.median("beta").alias("median_beta"),
        F.try_divide(F.var_samp(e), F.var_samp(y)).alias("variance_ratio"),
    )


def attenuation(raw: DataFrame, residual: DataFrame, roles: DataFrame) -> DataFrame:
    """Mean raw and residual correlation and density for each sample of roles (period, role)."""
    both = roles.join(raw, "period").join(residual.drop("n"), "period")
    names = ("mean_correlation", "density", "residual_mean_correlation", "residual_density")
    return both.groupBy("role").agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n_rows"))
