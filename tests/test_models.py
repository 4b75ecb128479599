"""Fitted models, folds and their diagnostics against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import diagnostics, models, quality, scoring, simulate

DAY = dt.date(2020, 1, 1)
NAMES = (*models.COMPONENTS, models.MOMENTUM)
DDL = "period date, label int, " + ", ".join(f"{c} double" for c in NAMES)


def plain_ap(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    out, seen, hits = 0.0, 0, 0
    for t in np.unique(s)[::-1]:
        at = s == t
        seen, hits = seen + at.sum(), hits + y[at].sum()
        out += y[at].sum() * hits / seen
    return out / y.sum()


def plain_fit(x, y, l2=0.1):
    """Gradient steps on the standardised features, to the optimum."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    b = np.zeros(z.shape[1])
    penalty = np.r_[0, np.full(x.shape[1], l2)]
    for _ in range(5000):
        p = 1 / (1 + np.exp(-z @ b))
        b -= 1.0 * (z.T @ (p - y) / len(y) + penalty * b)
    return b, lambda q: 1 / (1 + np.exp(-(b[0] + (q - mean) / std @ b[1:])))


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(3)
    n = 620
    x = draw.normal(size=(n, len(NAMES)))
    x[:, 3] = 0.7 * x[:, 0] + 0.3 * x[:, 3]
    y = (draw.random(n) < 1 / (1 + np.exp(1.2 - 1.5 * x[:, 2] - 0.5 * x[:, 0]))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    return spark.createDataFrame([(DAY + dt.timedelta(days=i), int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], DDL).cache()


def cut(start, size, k, parts):
    return int(start + (size - start) * k / parts)


def test_feature_selection(frame, data):
    x, y = data
    chosen, table = models.select_features(frame.withColumn("task", F.lit("t")))
    start, n, want = max(240, len(y) // 2), len(y), {}
    for names in models.candidates():
        at, scores = [models.COMPONENTS.index(c) for c in names], []
        for k in range(3):
            a, b = cut(start, n, k, 3), cut(start, n, k + 1, 3)
            _, p = plain_fit(x[: a - 7, at], y[: a - 7])
            scores.append(plain_ap(y[a:b], p(x[a:b, at])))
        want["+".join(names)] = np.mean(scores)
    got = {r.features: r for r in table.collect()}
    assert set(got) == set(want) and all(r.mean_average_precision == pytest.approx(want[k], abs=1e-6) and r.folds == 3 for k, r in got.items())
    near = [k for k, v in want.items() if v >= max(want.values()) - 0.005]
    pick = min(near, key=lambda k: (k.count("+"), -want[k]))
    assert chosen == {"t": tuple(pick.split("+"))} and [k for k, r in got.items() if r.selected] == [pick]


def test_outer_folds_and_scores(frame, data):
    x, y = data
    folds = models.outer_folds(frame, least=300).cache()
    start, n = max(300, len(y) // 2), len(y)
    roles = {(r.task, (r.period - DAY).days): r.role for r in folds.select("task", "period", "role").collect()}
    want = {}
    for k in range(4):
        a, b = cut(start, n, k, 4), cut(start, n, k + 1, 4)
        want |= {(str(k + 1), i): "test" for i in range(a, b)} | {(str(k + 1), i): "train" for i in range(a - 7)}
    assert roles == want
    scores = models.score_models(folds, {str(k): ("contraction",) for k in range(1, 5)}).where("role = 'test'").collect()
    assert len(scores) == 6 * (n - start)
    a, b = cut(start, n, 1, 4), cut(start, n, 2, 4)
    for name, at in (("logistic_all", list(range(5))), ("logistic_selected", [2])):
        _, p = plain_fit(x[: a - 7, at], y[: a - 7])
        got = {(r.period - DAY).days: r.score for r in scores if r.task == "2" and r.model == name}
        assert [got[i] for i in range(a, b)] == pytest.approx(p(x[a:b, at]).tolist(), abs=1e-6)
    low, high = np.quantile(x[: a - 7, 2], (0.05, 0.95))
    got = {(r.period - DAY).days: r.score for r in scores if r.task == "2" and r.model == "series_only"}
    assert [got[i] for i in range(a, b)] == pytest.approx(((np.clip(x[a:b, 2], low, high) - low) / (high - low)).tolist())
    assert quality.chronology(folds, 7).first().passed and quality.unique(folds.where("role = 'test'"), ["period"], "x").first().passed


def test_stability_inflation_and_increments(frame, data):
    x, y = data
    s = scoring.purged_split(frame).cache()
    roles = np.array([r.role for r in s.orderBy("period").collect()])
    own = {r: plain_fit(x[roles == r, :5], y[roles == r])[0] for r in ("train", "test")}
    for r in models.coefficient_stability(s).collect():
        k = 0 if r.component == "intercept" else 1 + models.COMPONENTS.index(r.component)
        assert r.coefficient == pytest.approx(own[r.role][k], abs=1e-6)
        assert r.sign_stable == (None if k == 0 else bool(np.sign(own["train"][k]) == np.sign(own["test"][k])))
    for r in models.variance_inflation(diagnostics.component_correlations(s.where("role <> 'purge'"))).collect():
        k, z = models.COMPONENTS.index(r.component), x[roles == r.role, :5]
        rest = np.column_stack([np.ones(len(z)), np.delete(z, k, axis=1)])
        left = z[:, k] - rest @ np.linalg.lstsq(rest, z[:, k], rcond=None)[0]
        assert r.vif == pytest.approx(z[:, k].var() / left.var())
    rows = {r.specification: r for r in models.incremental_tests(s).collect()}
    train, test = roles == "train", roles == "test"
    base = None
    for name in ("contraction_only", "contraction_plus_breadth", "all_components"):
        at = {"contraction_only": [2], "contraction_plus_breadth": [2, 4], "all_components": list(range(5))}[name]
        _, p = plain_fit(x[train][:, at], y[train])
        ap = plain_ap(y[test], p(x[test][:, at]))
        base = ap if base is None else base
        assert rows[name].test_average_precision == pytest.approx(ap, abs=1e-6) and rows[name].gain == pytest.approx(ap - base, abs=1e-6)
        assert rows[name].train_average_precision == pytest.approx(plain_ap(y[train], p(x[train][:, at])), abs=1e-6)


def test_reconciles(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, v double")
    passed = lambda b: quality.reconciles(a, spark.createDataFrame(b, "k string, v double"), ["k"], "v").first().passed
    assert passed([("x", 1.0 + 1e-14), ("y", None)]) and not passed([("x", 1.1), ("y", None)]) and not passed([("x", 1.0)])


def _cells(spark, weights):
    return spark.createDataFrame([(DAY + dt.timedelta(days=k), k + 1, e, v, 0.0) for k in range(8) for e, v in weights.items()], "period date, n int, entity string, value double, ret double")


NO_EDGES = "window int, threshold double, src string, dst string, rho double"


def test_no_path_is_lost(spark):
    """Three entities share the draw; cumulative weights that don't reach one lose no path."""
    cells = _cells(spark, {"a": 0.1, "b": 0.2, "c": 0.7})
    losses = spark.createDataFrame([(e, DAY, 0.4) for e in "abc"], "entity string, period date, loss double")
    got = simulate.cascade(cells, [("s", 0.5, 1, 0.45, 0.85, 0.5, 60, "value", 4000)], losses=losses, edges=spark.createDataFrame([], NO_EDGES)).first()
    assert got.mean_hit == 1.0 and got.mean_loss == pytest.approx(0.4 * (0.01 + 0.04 + 0.49), abs=0.01)


def test_an_empty_tail_is_an_error(spark):
    losses = spark.createDataFrame([("a", DAY, 0.4)], "entity string, period date, loss double")
    with pytest.raises(Exception, match="without a loss tail"):
        simulate.cascade(_cells(spark, {"a": 1.0, "b": 1.0}), [("s", 0.5, 1, 0.45, 0.85, 0.5, 60, "equal", 100)], losses=losses, edges=spark.createDataFrame([], NO_EDGES)).collect()


def test_tables_by_name_and_full_refresh(spark, tmp_path):
    from panelloom.sources import raw

    df = spark.range(3)
    raw.register({"three": df})
    raw.register({"three": df.where("id > 0")})
    assert spark.sql("SELECT count(*) FROM three").first()[0] == 2
    for n in (3, 1):
        paths = raw.full_refresh({"t": spark.range(n)}, str(tmp_path))
        assert spark.read.parquet(paths["t"]).count() == n


def _sql_fit(rows):
    """Coefficients by name from the SQL of fits, on rows (label, *components)."""
    import duckdb

    from panelloom.plans import logit_sql

    names = ", ".join(models.COMPONENTS)
    values = ", ".join(f"({int(r[0])}, {', '.join(f'{v!r}::DOUBLE' for v in map(float, r[1:]))})" for r in rows)
    source = f"(SELECT 'f' AS fit, {logit_sql.mask(models.COMPONENTS)} AS mask, label, {logit_sql.X} AS x FROM (VALUES {values}) AS v(label, {names}))"
    return duckdb.connect().execute(f"SELECT b FROM {logit_sql.fits(source)}").fetchone()[0]


@pytest.mark.parametrize("kind", ["none", "all", "rare", "outlier"])
def test_rare_labels_and_one_class(spark, kind):
    """Query and SQL reach the same optimum however rare the label is; of one class it is at the bound, without coefficients."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 5))
    y = np.full(len(x), int(kind == "all"))
    if kind in ("rare", "outlier"):
        y[[7, 1900]] = 1
    if kind == "outlier":
        x[7], x[1900] = 40.0, -3.0
    rows = [(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "label int, " + ", ".join(f"{c} double" for c in models.COMPONENTS)).withColumn("fit", F.lit("f"))
    m = models.fit_many(df, {"f": models.COMPONENTS}, max_iter=30)["f"]
    found = [m.intercept, *m.coefficients]
    assert found == pytest.approx(_sql_fit(rows), abs=1e-7)
    if kind in ("none", "all"):
        assert found == [35.0 if kind == "all" else -35.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    else:  # the gradient is zero there
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        e = 1 / (1 + np.exp(-(found[0] + z @ found[1:]))) - y
        assert abs(e.mean()) < 1e-9 and np.abs(z.T @ e / len(y) + 0.1 * np.array(found[1:])).max() < 1e-9


def test_signs_without_events(spark, frame):
    s = scoring.purged_split(frame.withColumn("label", F.lit(0)))
    rows = models.coefficient_stability(s).collect()
    assert len(rows) == 12 and {r.sign_stable for r in rows} == {None, True} and {r.coefficient for r in rows} == {-35.0, 0.0}


def test_candidates_share_their_rows(frame, monkeypatch):
    """Fits get a row once for each fold, not once for each candidate, and find what they find alone."""
    fit, seen = models.fit_many, []

    def counted(rows, uses, **kw):
        seen.append((rows.count(), len(uses)))
        return fit(rows, uses, **kw)

    monkeypatch.setattr(models, "fit_many", counted)
    models.select_features(frame.withColumn("task", F.lit("t")))
    n = 620
    assert seen == [(sum(cut(n // 2, n, k, 3) - 7 for k in range(3)), 3 * len(models.candidates()))]
    both = fit(frame.withColumn("fit", F.lit("s")), {"a": ("contraction",), "b": models.COMPONENTS}, samples={"a": "s", "b": "s"})
    for name, own in (("a", ("contraction",)), ("b", models.COMPONENTS)):
        alone = fit(frame.withColumn("fit", F.lit(name)), {name: own})[name]
        assert (both[name].intercept, *both[name].coefficients) == pytest.approx((alone.intercept, *alone.coefficients), abs=1e-12)
