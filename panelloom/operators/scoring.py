"""Chronological splits, scaling by training percentiles, and scores without a fitted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from .features import COMPONENTS, MOMENTUM, WEIGHTS
from .quantiles import percentiles
from .scan import Ordered

TRAIN_SHARE = 0.70


def numbered(frame: DataFrame) -> DataFrame:
    """Rows numbered from 0 by period as `i`, and their number `rows`."""
    f = Ordered.of(frame, ["period"]).result("i", 0)
    return f.crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("rows"))))  # one row


def purged_split(frame: DataFrame, horizon: int = 7, share: float = TRAIN_SHARE) -> DataFrame:
    """frame with role: the holdout starts at a row's period, and `horizon` days before it are purged."""
    out = numbered(frame)
    at = F.least(F.greatest(F.floor(F.col("rows") * share).cast("int"), F.lit(1)), F.col("rows") - 1)
    start = out.where(F.col("i") == at).agg(F.max("period").alias("holdout_start"))
    return with_roles(out.drop("i", "rows").crossJoin(F.broadcast(start)), horizon)  # one row


def with_roles(frame: DataFrame, horizon: int | Column) -> DataFrame:
    """role by the column holdout_start."""
    role = F.when(F.col("period") >= F.col("holdout_start"), "test").when(F.col("period") < F.date_sub("holdout_start", horizon), "train").otherwise("purge")
    return frame.withColumn("role", role)


def fit_scaler(train: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group) with low_<c> and high_<c>: exact 5th and 95th percentiles, apart by 1 if they are equal."""
    got = percentiles(train, list(by), columns, [0.05, 0.95])
    low, high = F.col("q")[0], F.col("q")[1]
    got = got.select(*by, "column", low.alias("low"), F.when(high > low, high).otherwise(low + 1.0).alias("high"))
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{k}_{c}") for c in columns for k in ("low", "high")])


def apply_scaler(frame: DataFrame, scaler: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = (), clipped: bool = True) -> DataFrame:
    """frame with z_<c> for each column; a scaler has one row, or one for each group."""
    both = frame.join(F.broadcast(scaler), list(by)) if by else frame.crossJoin(F.broadcast(scaler))

    def z(c: str) -> Column:
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        x = F.col(c)
        bounded = F.when(x.isNotNull(), F.least(F.greatest(x, low), high)) if clipped else x
        return (bounded - low) / (high - low)

    return both.withColumns({f"z_{c}": z(c) for c in columns}).drop(*[f"{k}_{c}" for c in columns for k in ("low", "high")])


def weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.lit(w) * F.col(f"z_{c}")
    return out


def mean_of(columns: tuple[str, ...]) -> Column:
    return weighted({c: 1.0 for c in columns}) / float(len(columns))


SIMPLE = ("heuristic", "equal_component", "series_only", MOMENTUM)


def simple_scores() -> dict[str, Column]:
    return {"heuristic": weighted(WEIGHTS), "equal_component": mean_of(COMPONENTS), "series_only": F.col("z_contraction"), MOMENTUM: F.col(f"z_{MOMENTUM}")}


def long_scores(frame: DataFrame, scores: dict[str, Column], keep: tuple[str, ...] = ("period", "role", "label"), name: str = "model") -> DataFrame:
    """One row for each row and score: keep, the score's name, score."""
    each = F.array(*[F.struct(F.lit(k).alias(name), v.alias("score")) for k, v in scores.items()])
    return frame.select(*keep, F.explode(each).alias("_s")).select(*keep, f"_s.{name}", "_s.score")


def scaled(frame: DataFrame, columns: tuple[str, ...] = (*COMPONENTS, MOMENTUM), clipped: bool = True) -> DataFrame:
    """A split frame scaled by its own training rows."""
    return apply_scaler(frame, fit_scaler(frame.where("role = 'train'"), columns), columns, clipped=clipped)


def clip_score(c: Column) -> Column:
    return clip(c, 0.0, 1.0)
