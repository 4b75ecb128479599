"""Rank metrics, thresholds and confusion counts of scores, by any keys.

Scores are grouped first, so that ties form one point and windows run over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles
from .scan import ROWS, below_and_all
from .scoring import clip_score

MAX_ALERT_RATE = 0.30
POINTS = 301


def _points(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    return df.groupBy(*keys, F.col(score).alias("_x")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))


def rank_metrics(df: DataFrame, keys: list[str], label: str = "label", score: str = "score", rows: int = ROWS) -> DataFrame:
    """(keys, observations, events, average_precision, roc_auc); null where a class is missing.

    Over `rows` distinct scores and more, counts up to each score come from ranges of (keys, score), so that a key
    may have any number of scores; below that, from a window for each key.
    """
    g = below_and_all(_points(df, keys, label, score), keys, ["_x"], {"_lp": "_p", "_ln": "_n"}, rows)
    # At or above a score is all that is not below it.
    pos, n = F.max("_lp_all"), F.max("_ln_all")
    ap = F.try_divide(F.sum(F.col("_p") * (F.col("_lp_all") - F.col("_lp_below")) / (F.col("_ln_all") - F.col("_ln_below"))), F.when(pos > 0, pos))
    ranks = F.sum(F.col("_p") * (F.col("_ln_below") + (F.col("_n") + 1) / 2.0))
    auc = F.try_divide(ranks - pos * (pos + 1) / 2.0, F.when((pos > 0) & (n > pos), (pos * (n - pos)).cast("double")))
    return g.groupBy(*keys).agg(n.alias("observations"), pos.alias("events"), ap.alias("average_precision"), auc.alias("roc_auc"))


def average_ranks(c: str, keys: list[str]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0


def pearson(x: Column, y: Column) -> Column:
    """Correlation of complete pairs as an aggregate; null without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def confusion(df: DataFrame, keys: list[str], threshold: Column, label: str = "label", score: str = "score") -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    count = lambda c: F.count_if(c)
    return df.groupBy(*keys).agg(count(y & p).alias("tp"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(~y & ~p).alias("tn"))


def choose_thresholds(df: DataFrame, keys: list[str], label: str = "label", score: str = "score", cap: float = MAX_ALERT_RATE, points: int = POINTS) -> DataFrame:
    """(keys, threshold): of `points` quantiles the one of the best F2, then recall, precision and size, among
    those that alert on at most `cap` of the rows; the largest if none does.

    Cumulative counts over distinct scores take the place of comparing all scores with all candidates.
    """
    g = _points(df, keys, label, score)
    candidates = percentiles(df, keys, (score,), [k / (points - 1) for k in range(points)]).select(*keys, F.explode(F.array_distinct("q")).alias("_x"))
    both = g.select(*keys, "_x", "_p", "_n", F.lit(False).alias("_ask")).unionByName(candidates.select(*keys, "_x", F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_ask")))
    # A candidate alerts on the scores at or above it: in descending order, all before it and its equals.
    down = Window.partitionBy(*keys).orderBy(F.col("_x").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    c = both.withColumns({"_tp": F.sum("_p").over(down), "_k": F.sum("_n").over(down), "_pos": F.sum("_p").over(whole), "_all": F.sum("_n").over(whole)}).where("_ask")
    precision = F.coalesce(F.try_divide("_tp", "_k"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("_tp", "_pos"), F.lit(0.0))
    c = c.withColumns({"_pr": precision, "_re": recall})
    f2 = F.coalesce(F.try_divide(5.0 * F.col("_pr") * F.col("_re"), 4.0 * F.col("_pr") + F.col("_re")), F.lit(0.0))
    fits = F.col("_k") / F.col("_all") <= cap
    best = F.max(F.when(fits, F.struct(f2.alias("f2"), F.col("_re").alias("re"), F.col("_pr").alias("pr"), F.col("_x").alias("x"))))
    return c.groupBy(*keys).agg(best.alias("_b"), F.max("_x").alias("_last")).select(*keys, F.coalesce("_b.x", "_last").alias("threshold"))


def metric_rows(df: DataFrame, thresholds: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """One row of nineteen metrics for each key, at its threshold."""
    y = F.col(label)
    with_t = df.join(thresholds, keys)
    counts = confusion(with_t, [*keys, "threshold"], F.col("threshold"), label, score)
    ranks = rank_metrics(df, keys, label, score)
    brier = df.groupBy(*keys).agg(F.avg((clip_score(F.col(score)) - y) * (clip_score(F.col(score)) - y)).alias("brier_score"))
    m = counts.join(ranks, keys).join(brier, keys)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    m = m.withColumns({"alerts": F.col("tp") + F.col("fp"), "prevalence": F.col("events") / F.col("observations"), "precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    m = m.withColumns({"alert_rate": F.col("alerts") / F.col("observations"), "f1": zero(2.0 * p * r, p + r), "f2": zero(5.0 * p * r, 4.0 * p + r), "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))})
    return m.withColumn("balanced_accuracy", (r + F.col("specificity")) / 2.0)
