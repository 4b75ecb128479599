"""The bootstrap by multiplicities against resampled rows."""

import datetime
import random

import pytest

from panelloom.operators import simulate
from panelloom.operators.metrics import rank_metrics

FIELDS = "period date, label int, score double"


def _rows(spark, n, scores, labels, seed=3):
    draw = random.Random(seed)
    return spark.createDataFrame([(datetime.date(2000, 1, 1) + datetime.timedelta(k), labels(draw), scores(draw)) for k in range(n)], FIELDS)


@pytest.mark.parametrize(("scores", "piece", "span"), [
    (lambda d: d.random(), 4096, 1 << 16),
    (lambda d: d.random(), 32, 40),
    (lambda d: d.choice([0.1, 0.1, 0.1, 0.4, 0.9]), 32, 3),  # one score holds most rows, over many pieces
    (lambda d: d.choice([None, float("nan"), 0.2, 0.5, d.random()]), 50, 20),
])
def test_same_as_resampled_rows(spark, scores, piece, span):
    rows = _rows(spark, 400, scores, lambda d: int(d.random() < 0.2))
    want = {r.rep: r.average_precision for r in rank_metrics(simulate.bootstrap_samples(rows, 30), ["rep"]).collect()}
    got = {r.rep: r.average_precision for r in simulate.resampled_precision(rows, 30, piece=piece, span=span).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 30


def test_counts_add_up(spark):
    """Blocks longer than a piece, counts over 255, and every replication as long as the rows."""
    rows = _rows(spark, 1000, lambda d: 0.5, lambda d: 1)
    got = simulate.multiplicities(rows, 5, block=100, piece=600).collect()
    assert len(got) == 2 and (simulate._unpacked([bytes(r.times) for r in got], 5).sum(axis=0) == 1000).all()
    assert simulate.multiplicities(rows, 5, block=100, piece=30).count() == 34


def test_no_events_and_no_rows(spark):
    none = simulate.block_bootstrap(_rows(spark, 40, lambda d: d.random(), lambda d: 0), 10).first()
    assert none.replications == 0 and none.without_events == 10 and none.ci_lower_95 is None
    assert simulate.resampled_precision(spark.createDataFrame([], FIELDS), 10).count() == 0
    few = simulate.resampled_precision(_rows(spark, 3, lambda d: d.random(), lambda d: 1), 4).collect()  # fewer rows than a block
    assert [r.average_precision for r in few] == [1.0] * 4
