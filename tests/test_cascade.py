"""Both ways of a cascade: paths that hold all entities, and rows of hits joined with a table of edges."""

import datetime as dt
import random

import pytest

from panelloom.operators import simulate

DAY = dt.date(2020, 1, 1)


def inputs(spark, n):
    draw = random.Random(7)
    names = [f"e{k:03d}" for k in range(n)]
    value = {e: draw.choice([0.0, 1.0, 5.0, 40.0]) for e in names}
    cells = spark.createDataFrame([(DAY + dt.timedelta(days=k), k + 1, e, value[e], 0.0) for k in range(3) for e in names], "period date, n int, entity string, value double, ret double")
    losses = spark.createDataFrame([(e, DAY + dt.timedelta(days=k), draw.random()) for e in names for k in range(12)], "entity string, period date, loss double")
    edges = spark.createDataFrame([(w, t, a, b, draw.uniform(-0.2, 0.9)) for w, t in ((60, 0.45), (30, 0.3)) for a in names for b in names if a != b and draw.random() < 8 / n], "window int, threshold double, src string, dst string, rho double")
    return cells, losses, edges


@pytest.mark.parametrize("jitter", [True, False])
def test_both_ways_agree(spark, jitter):
    cells, losses, edges = inputs(spark, 40)
    scenarios = [("a", 0.7, 3, 0.45, 0.85, 0.5, 60, "value", 300), ("b", 0.5, 1, 0.3, 0.8, 0.3, 30, "equal", 200), ("no edges", 0.9, 2, 0.45, 0.85, 0.5, 90, "equal", 100)]
    one, two = ([tuple(r) for r in simulate.cascade(cells, scenarios, losses=losses, edges=edges, jitter=jitter, whole=w).orderBy("scenario").collect()] for w in (400, 0))
    assert len(one) == 3 and one[0][-1] > 1.5 and one[2][-1] == 1.0
    for x, y in zip(one, two, strict=True):
        assert x[:9] == y[:9] and x[9:] == pytest.approx(y[9:])


def test_missing_tail_fails_either_way(spark):
    cells, losses, edges = inputs(spark, 10)
    few = losses.where("entity < 'e004'")
    for w in (400, 0):
        with pytest.raises(Exception, match="without a loss tail"):
            simulate.cascade(cells, [("s", 0.5, 1, 0.45, 0.85, 0.5, 60, "equal", 200)], losses=few, edges=edges, whole=w).collect()


def test_thousands_of_entities(spark):
    """3,000 entities with a few edges each never meet as a square."""
    cells, losses, edges = _ring(spark, 3000)
    got = simulate.cascade(cells, [("s", 1.0, 2, 0.45, 0.85, 0.5, 60, "equal", 200)], losses=losses, edges=edges, jitter=False).first()
    assert got.mean_hit == 3.0 and got.mean_loss == pytest.approx((0.4 + 0.4 * 0.5 + 0.4 * 0.25) / 3000)


def _ring(spark, n):
    cells = spark.range(n).selectExpr("date'2020-01-01' AS period", "1 AS n", "cast(id AS string) AS entity", "1.0D AS value", "0.0D AS ret")
    losses = spark.range(n).selectExpr("cast(id AS string) AS entity", "date'2020-01-01' AS period", "0.4D AS loss")
    edges = spark.range(n).selectExpr("60 AS window", "0.45D AS threshold", "cast(id AS string) AS src", f"cast((id + 1) % {n} AS string) AS dst", "0.5D AS rho")
    return cells, losses, edges
