"""Metrics, thresholds, splits, models, episodes and cascades against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import diagnostics, episodes, metrics, models, quality, scoring, simulate

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def plain_metrics(y, s):
    pos = sum(y)
    ap, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = [b for a, b in zip(s, y, strict=True) if a >= t]
        recall = sum(hit) / pos if pos else 0
        ap, seen = ap + (recall - seen) * sum(hit) / len(hit), recall
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(s, y, strict=True) if p for b, q in zip(s, y, strict=True) if not q]
    return ap if pos else None, sum(pairs) / len(pairs) if pairs else None


def plain_threshold(y, s):
    c = sorted(set(np.quantile(s, np.linspace(0, 1, 301)).tolist()))
    best = (-1.0, -1.0, -1.0, c[-1])
    for t in c:
        p = [a >= t for a in s]
        if sum(p) / len(p) > 0.30:
            continue
        tp = sum(a and b for a, b in zip(p, y, strict=True))
        precision, recall = tp / sum(p) if sum(p) else 0.0, tp / sum(y) if sum(y) else 0.0
        best = max(best, (5 * precision * recall / (4 * precision + recall) if precision + recall else 0.0, recall, precision, t))
    return best[-1]


def test_rank_metrics_and_thresholds(spark):
    draw = random.Random(1)
    sets = {"ties": ([draw.randrange(2) for _ in range(60)], [draw.randrange(8) / 8 for _ in range(60)]), "all": ([1] * 9, [k / 9 for k in range(9)]), "none": ([0] * 9, [k / 9 for k in range(9)]), "flat": ([0, 1, 1, 0], [0.5] * 4), "fine": ([draw.randrange(2) for _ in range(200)], [draw.random() for _ in range(200)])}
    df = spark.createDataFrame([(k, a, b) for k, (y, s) in sets.items() for a, b in zip(y, s, strict=True)], "model string, label int, score double")
    got = {r.model: r for r in metrics.rank_metrics(df, ["model"]).collect()}
    cut = {r.model: r.threshold for r in metrics.choose_thresholds(df, ["model"]).collect()}
    for k, (y, s) in sets.items():
        ap, auc = plain_metrics(y, s)
        assert (got[k].average_precision, got[k].roc_auc) == (pytest.approx(ap), pytest.approx(auc))
        assert cut[k] == pytest.approx(plain_threshold(y, s))
    rows = {r.model: r for r in metrics.metric_rows(df, metrics.choose_thresholds(df, ["model"]), ["model"]).collect()}
    assert all(r.tp + r.fp + r.fn + r.tn == len(sets[k][0]) for k, r in rows.items())
    assert rows["all"].specificity is None and rows["none"].recall == 0.0


def test_purged_split(spark):
    df = spark.createDataFrame([(day(2 * k),) for k in range(20)], "period date")
    got = {r.period: r.role for r in scoring.purged_split(df).collect()}
    start = day(28)  # row 14 of 20
    assert all(r == ("test" if p >= start else "train" if p < start - dt.timedelta(days=7) else "purge") for p, r in got.items())


def test_scaler_without_spread(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert tuple(scoring.fit_scaler(df, ("x",)).first()) == (5.0, 6.0)


def test_deciles_with_a_remainder(spark):
    rows = [(day(k), "train", k % 2, float(k)) for k in range(23)]
    df = spark.createDataFrame(rows, "period date, role string, label int, x double")
    got = {r.decile: r.observations for r in diagnostics.deciles(df, ("x",)).collect()}
    edges = np.quantile(np.arange(1, 24), np.linspace(0, 1, 11))
    want = {k + 1: int(sum((edges[k] < r <= edges[k + 1]) or (k == 0 and r == 1) for r in range(1, 24))) for k in range(10)}
    assert got == want


def test_logistic(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 5))
    y = (draw.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    ddl = "fit string, label int, " + ", ".join(f"{c} double" for c in models.COMPONENTS)
    df = spark.createDataFrame([(f, int(b), *map(float, a)) for f in ("full", "one") for a, b in zip(x, y, strict=True)], ddl)
    m = models.fit_many(df, {"full": models.COMPONENTS, "one": ("correlation",)})
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    p = 1 / (1 + np.exp(-(m["full"].intercept + z @ np.array(m["full"].coefficients))))
    assert np.abs(np.r_[(p - y).mean(), z.T @ (p - y) / 300 + 0.1 * np.array(m["full"].coefficients)]).max() < 1e-8  # the gradient
    assert m["one"].features == ("correlation",) and m["one"].coefficients[0] > 0
    scored = models.with_probability(df.where("fit = 'full'"), m).collect()
    assert sorted(r.score for r in scored) == pytest.approx(sorted(p))


def test_episodes(spark):
    label = [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 1, 0]
    alert = [0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0]
    rows = spark.createDataFrame([(day(k), a, float(b), b) for k, (a, b) in enumerate(zip(label, alert, strict=True))], "period date, label int, score double, alert int")
    cells = spark.createDataFrame([(day(k), e, -0.1 if k == 8 else 0.01 * (k - 8) if e == "a" else None) for k in range(20) for e in ("a", "b")], "period date, entity string, ret double")
    frame = spark.createDataFrame([(day(8), math.log(0.9))], "period date, forward_return double")
    first, second = episodes.stress_episodes(rows, cells, frame).orderBy("episode").collect()
    assert (first.onset, first.end, first.duration, first.lead_days, first.pre_onset_alert, first.after_onset_only) == (day(8), day(9), 2, 7, 1, 0)  # seven days before counts
    assert first.severity == pytest.approx(0.1) and first.worst_entities == "a:0.280"  # the onset's own return does not
    assert (second.duration, second.lead_days, second.alert_from_onset) == (1, 1, 0)
    assert [(r.start, r.duration) for r in episodes.false_alert_runs(rows).orderBy("run").collect()] == [(day(1), 1), (day(10), 1)]


def test_bootstrap_sizes(spark):
    rows = spark.createDataFrame([(day(k), k % 3 == 0, k / 30) for k in range(30)], "period date, label boolean, score double").withColumn("label", F.col("label").cast("int"))
    n = simulate.bootstrap_samples(rows, 20).groupBy("rep").count().collect()
    assert len(n) == 20 and all(r["count"] == 30 for r in n)
    got = simulate.block_bootstrap(rows, 20).first()
    assert got.ci_lower_95 <= got.ci_upper_95 and got.replications + got.without_events == 20


@pytest.mark.parametrize(("edges", "rounds", "want"), [([("a", "b")], 1, 0.4 + 0.2), ([("a", "b"), ("b", "c")], 1, 0.6), ([("a", "b"), ("b", "c")], 2, 0.7), ([("a", "b"), ("a", "c"), ("b", "c")], 3, 0.8)])
def test_cascade(spark, edges, rounds, want):
    """One entity holds all the weight of the draw; a shock of 0.4 halves with each step."""
    cells = spark.createDataFrame([(day(k), k + 1, e, v, 0.0) for k in range(8) for e, v in (("a", 1.0), ("b", 0.0), ("c", 0.0))], "period date, n int, entity string, value double, ret double")
    links = spark.createDataFrame([(60, 0.45, a, b, 1.0) for a, b in edges], "window int, threshold double, src string, dst string, rho double")
    losses = spark.createDataFrame([("a", day(0), 0.4)], "entity string, period date, loss double")
    scenario = ("s", 0.5, rounds, 0.45, 0.85, 0.5, 60, "value", 10)
    got = simulate.cascade(cells, [scenario], losses=losses, edges=links, jitter=False).first()
    assert got.mean_loss == pytest.approx(0.4) and got.mean_hit == {0.6: 2, 0.7: 3, 0.8: 3}[round(want, 1)]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, n int")
    report = quality.report([quality.unique(df, ["k"], "one"), quality.row_count(df, 2, "two")])
    assert {r.check: r.passed for r in report.collect()} == {"one": False, "two": True}
    with pytest.raises(RuntimeError, match="one"):
        quality.require(report)


def test_scenario_grid_runs_all_paths(spark, monkeypatch):
    from panelloom.plans import registry

    asked = []
    monkeypatch.setattr(registry, "_cells", lambda spark, sf: spark.range(1))
    monkeypatch.setattr(simulate, "cascade", lambda cells, scenarios: asked.extend(scenarios))
    registry.scenario_grid(spark, "")
    assert len(asked) == 66 and {s[-1] for s in asked if s[0].startswith("grid")} == {3000} and {s[-1] for s in asked if s[0].startswith("base")} == {5000}


def test_bootstrap_query_runs_all_replications(spark, monkeypatch):
    from panelloom.plans import registry

    rows = spark.createDataFrame([(day(k), int(k % 3 == 0), k / 30) for k in range(30)], "period date, label int, score double")
    monkeypatch.setattr(registry, "_alerts", lambda spark, sf: rows)
    got = registry.block_bootstrap(spark, "").first()
    assert got.replications + got.without_events == 1000
