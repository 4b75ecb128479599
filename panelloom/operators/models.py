"""Regularised logistic models, feature selection and walk-forward validation.

Many models are fitted together by Newton steps: a step is one pass over all rows that sums gradients and second
derivatives by model, combined within tasks before anything is shuffled, and the driver solves the small systems. Models that
learn from the same rows share them. A model may have any number of rows; what is collected and broadcast has a few rows for each model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from .features import COMPONENTS, MOMENTUM
from .metrics import rank_metrics
from .scoring import apply_scaler, fit_scaler, long_scores, simple_scores

L2 = 0.10
BOUND = 35.0  # of the linear predictor, as in sigmoid
ANCHOR = "contraction"


@dataclass(frozen=True)
class Fitted:
    """A model on standardised features: population mean and deviation, no deviation counting as one."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]


def model_table(spark: SparkSession, models: dict[str, Fitted], columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(fit, _b, _w, _m, _s): intercept, and arrays of coefficients (zero where unused), means and deviations by column."""
    rows = []
    for f, m in models.items():
        at = [m.features.index(c) if c in m.features else None for c in columns]
        pick = lambda values, none, at=at: [none if k is None else float(values[k]) for k in at]
        rows.append((f, float(m.intercept), pick(m.coefficients, 0.0), pick(m.means, 0.0), pick(m.stds, 1.0)))
    return spark.createDataFrame(rows, "fit string, _b double, _w array<double>, _m array<double>, _s array<double>")


def with_probability(rows: DataFrame, models: dict[str, Fitted], name: str = "score", columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """rows (fit, columns) of the given models, with the probability by the model that `fit` names."""
    both = rows.join(F.broadcast(model_table(rows.sparkSession, models, columns)), "fit")  # a row for each model
    return both.withColumn(name, sigmoid(_line(columns), BOUND)).drop("_b", "_w", "_m", "_s")


def _standard(columns: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) - F.get("_m", F.lit(k))) / F.get("_s", F.lit(k)) for k, c in enumerate(columns)]


def _line(columns: tuple[str, ...]) -> Column:
    out = F.col("_b")
    for k, z in enumerate(_standard(columns)):
        # A column that a model does not use may be missing.
        out = out + F.when(F.get("_w", F.lit(k)) != 0, F.get("_w", F.lit(k)) * z).otherwise(F.lit(0.0))
    return out


def _sums(rows: DataFrame, models: dict[str, Fitted], sample: dict[str, str], columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """For each model: number of rows, and sums of losses, of gradients and of second derivatives, over rows (fit, _y, columns) of its sample.

    Tasks sum their own rows, all models of a sample at once, and Spark sums the tasks; rows that lack a feature don't count for the model.
    """
    own: dict[str, list[tuple]] = {}
    for f, m in models.items():
        own.setdefault(sample[f], []).append((f, [columns.index(c) for c in m.features], np.array([m.intercept, *m.coefficients]), np.array(m.means), np.array(m.stds)))

    def summed(batches):
        import pyarrow as pa

        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for k, name in enumerate(names.dictionary.to_pylist()):
                part = values[codes == k]
                for f, at, beta, means, stds in own.get(name, ()):
                    z = np.column_stack([np.ones(len(part)), (part[:, 1:][:, at] - means) / stds])
                    there = ~np.isnan(z).any(axis=1)
                    z, y = z[there], part[there, 0]
                    p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -BOUND, BOUND)))
                    loss = -np.log(np.where(y == 1, p, 1.0 - p)).sum()
                    terms = np.concatenate([[len(z), loss], z.T @ (p - y), (z.T @ (z * (p * (1.0 - p))[:, None])).ravel()])
                    found[f] = found[f] + terms if f in found else terms
        if found:
            yield pa.RecordBatch.from_pydict({"fit": list(found), "s": [v.tolist() for v in found.values()]}, pa.schema([("fit", pa.string()), ("s", pa.list_(pa.float64()))]))

    each = rows.where(F.col("fit").isin(sorted(own))).mapInArrow(summed, "fit string, s array<double>")
    total = each.select("fit", F.posexplode("s").alias("k", "v")).groupBy("fit", "k").agg(F.sum("v").alias("v"))
    out = {f: np.zeros(2 + (len(m.features) + 1) * (len(m.features) + 2)) for f, m in models.items()}
    for r in total.collect():  # up to 44 rows for each model
        out[r["fit"]][r["k"]] = r["v"]
    return out


def fit_many(rows: DataFrame, uses: dict[str, tuple[str, ...]], label: str = "label", columns: tuple[str, ...] = COMPONENTS, l2: float = L2, max_iter: int = 200, tol: float = 1e-10, samples: dict[str, str] | None = None) -> dict[str, Fitted]:
    """A model for each value of rows.fit, with the features that `uses` names for it.

    Where several models learn from the same rows, `samples` names the value of rows.fit for each model, and the rows are there once.
    The loss is the mean logistic loss plus l2 / 2 times the squared coefficients of standardised features, the intercept
    free. Labels of one class have no finite optimum: coefficients are zero there, and the intercept is the bound of the linear
    predictor. Steps start at the log odds of the label; one that raises the loss is halved. rows are read once for their moments
    and once for each step (about six), so the caller keeps them.
    """
    sample = samples or {f: f for f in uses}
    facts = rows.groupBy("fit").agg(F.avg(F.col(label).cast("double")).alias("share"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    found = {r["fit"]: r for r in facts.collect()}  # a row for each sample
    models, left = {}, {}
    for f, own in uses.items():
        if sample[f] not in found:
            continue
        r = found[sample[f]]
        share = r["share"]
        one = share in (0.0, 1.0)
        start = BOUND * (2.0 * share - 1.0) if one else float(np.log(share / (1.0 - share)))
        models[f] = Fitted(own, start, (0.0,) * len(own), tuple(r[f"m_{c}"] for c in own), tuple(r[f"s_{c}"] or 1.0 for c in own))
        if not one:
            left[f] = models[f]
    base = rows.select("fit", F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns])
    before: dict[str, tuple[float, np.ndarray]] = {}  # loss and terms that the last step started from
    for _ in range(max_iter if left else 0):
        for f, s in _sums(base, left, sample, columns).items():
            m = left[f]
            k = len(m.features) + 1
            loss, gradient, second = s[1] / s[0], s[2 : 2 + k] / s[0], s[2 + k :].reshape(k, k) / s[0]
            beta, penalty = np.array([m.intercept, *m.coefficients]), np.r_[0.0, np.full(len(m.features), l2)]
            cost = loss + float(penalty @ beta**2) / 2
            was, origin = before.get(f, (np.inf, beta))
            if cost > was + 1e-9:  # beyond rounding
                step = (beta - origin) / 2
            else:
                before[f] = (cost, beta)
                step = np.linalg.solve(second + np.diag(penalty) + 1e-12 * np.eye(k), gradient + penalty * beta)
            beta = beta - step
            models[f] = left[f] = Fitted(m.features, float(beta[0]), tuple(map(float, beta[1:])), m.means, m.stds)
            if np.abs(step).max() < tol:
                del left[f]
        if not left:
            break
    return models


def candidates(columns: tuple[str, ...] = COMPONENTS, anchor: str = ANCHOR) -> list[tuple[str, ...]]:
    return [*[(c,) for c in columns], *[(anchor, c) for c in columns if c != anchor], tuple(columns)]


def _linspace(start: Column, stop: Column, k: int, parts: int) -> Column:
    return F.floor(start + (stop - start) * (k / parts)).cast("int")


def select_features(train: DataFrame, horizon: int = 7, folds: int = 3, margin: float = 0.005) -> tuple[dict[str, tuple[str, ...]], DataFrame]:
    """For each task of train (task, period, label, components): the chosen features; and all results.

    Folds follow each other in time; a fold's model learns from the periods that end `horizon` days before it. Of the
    candidates within `margin` of the best mean average precision the one of fewest features wins, then the best.
    """
    by = Window.partitionBy("task")
    t = train.withColumns({"i": F.row_number().over(by.orderBy("period")) - 1, "size": F.count(F.lit(1)).over(by)})
    start = F.greatest(F.lit(240), F.floor(F.col("size") * 0.5))
    parts = [F.struct(F.lit(k).alias("fold"), _linspace(start, F.col("size"), k, folds).alias("a"), _linspace(start, F.col("size"), k + 1, folds).alias("b")) for k in range(folds)]
    t = t.withColumn("f", F.explode(F.array(*parts))).withColumns({"fold": F.col("f.fold"), "tested": (F.col("i") >= F.col("f.a")) & (F.col("i") < F.col("f.b"))}).drop("f", "size")
    key = Window.partitionBy("task", "fold")
    t = t.withColumn("cut", F.min(F.when(F.col("tested"), F.col("period"))).over(key))
    t = t.withColumn("learns", F.col("period") < F.date_sub("cut", horizon)).where("tested OR learns")
    kinds = lambda c: F.count_if(c & (F.col("label") == 1)).over(key) * F.count_if(c & (F.col("label") == 0)).over(key)
    t = t.withColumns({"k1": kinds(F.col("tested")), "k2": kinds(F.col("learns") & ~F.col("tested")), "k3": F.count_if(F.col("learns") & ~F.col("tested")).over(key)})
    t = t.where("k1 > 0 AND k2 > 0 AND k3 >= 150").drop("k1", "k2", "k3", "cut")
    t = t.persist()  # read by every step
    try:
        own = ["+".join(c) for c in candidates()]
        each = t.withColumn("features", F.explode(F.array(*[F.lit(n) for n in own]))).withColumn("fit", F.concat_ws("|", "task", F.col("fold").cast("string"), "features"))
        learn = t.where("learns AND NOT tested").withColumn("fit", F.concat_ws("|", "task", F.col("fold").cast("string")))
        there = [r[0] for r in learn.select("fit").distinct().collect()]  # tasks x folds
        models = fit_many(learn, {f"{s}|{n}": c for s in there for n, c in zip(own, candidates(), strict=True)}, samples={f"{s}|{n}": s for s in there for n in own})
        scored = with_probability(each.where("tested"), models)
        found = rank_metrics(scored, ["task", "features", "fold"]).groupBy("task", "features").agg(F.size(F.split(F.first("features"), r"\+")).alias("n_features"), F.avg("average_precision").alias("mean_average_precision"), F.count("average_precision").cast("int").alias("folds"))
        best = F.max("mean_average_precision").over(Window.partitionBy("task"))
        rank = F.row_number().over(Window.partitionBy("task").orderBy(F.col("mean_average_precision") < best - margin, "n_features", F.desc("mean_average_precision"), "features"))
        rows = found.withColumn("selected", rank == 1).collect()  # tasks x candidates
    finally:
        t.unpersist()
    table = train.sparkSession.createDataFrame(rows, "task string, features string, n_features int, mean_average_precision double, folds int, selected boolean")
    return {r["task"]: tuple(r["features"].split("+")) for r in rows if r["selected"]}, table


def score_models(frame: DataFrame, selected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(task, period, role, label, model, score): four simple scores and two logistic ones, each task by its own training rows."""
    columns = (*COMPONENTS, MOMENTUM)
    train = frame.where("role = 'train'")
    z = apply_scaler(frame.where("role <> 'purge'"), fit_scaler(train, columns, ("task",)), columns, ("task",))
    out = long_scores(z, simple_scores(), ("task", "period", "role", "label"))
    tasks = [r[0] for r in train.select("task").distinct().collect()]
    specs = {f"{t}|logistic_all": tuple(COMPONENTS) for t in tasks} | {f"{t}|logistic_selected": c for t, c in (selected or {}).items() if t in tasks}
    kinds = ("logistic_all", "logistic_selected")
    each = frame.where("role <> 'purge'").withColumn("model", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("fit", F.concat_ws("|", "task", "model"))
    each = each.where(F.col("fit").isin(sorted(specs)))
    learn = train.withColumn("fit", F.col("task"))
    models = fit_many(learn, specs, samples={f: f.rsplit("|", 1)[0] for f in specs})
    return out.unionByName(with_probability(each, models).select("task", "period", "role", "label", "model", "score"))


def outer_folds(frame: DataFrame, horizon: int = 7, folds: int = 4, least: int = 500) -> DataFrame:
    """frame once for each fold as task '1', '2', ...: test rows of the fold, training rows before the purge."""
    from .scoring import numbered

    f = numbered(frame)
    start = F.greatest(F.lit(least), F.floor(F.col("rows") * 0.5))
    parts = [F.struct(F.lit(str(k + 1)).alias("task"), _linspace(start, F.col("rows"), k, folds).alias("a"), _linspace(start, F.col("rows"), k + 1, folds).alias("b")) for k in range(folds)]
    f = f.withColumn("f", F.explode(F.array(*parts))).withColumn("task", F.col("f.task"))
    tested = (F.col("i") >= F.col("f.a")) & (F.col("i") < F.col("f.b"))
    cut = F.min(F.when(tested, F.col("period"))).over(Window.partitionBy("task"))
    role = F.when(tested, "test").when(F.col("period") < F.date_sub(cut, horizon), "train")
    return f.withColumn("role", role).where("role IS NOT NULL").drop("f", "i", "rows")


def pooled(scores: DataFrame, by_fold: DataFrame) -> DataFrame:
    """Metrics of each model over the test rows of all folds, and mean and deviation of its folds' average precision."""
    every = rank_metrics(scores.where("role = 'test'"), ["model"])
    spread = by_fold.groupBy("model").agg(F.avg("average_precision").alias("fold_ap_mean"), F.stddev_samp("average_precision").alias("fold_ap_std"))
    return every.join(spread, "model")


def coefficients(spark: SparkSession, models: dict[str, Fitted], columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(fit, component, coefficient): a row for each model and term, the intercept among them."""
    terms = [F.struct(F.lit("intercept").alias("component"), F.col("_b").alias("coefficient")), *[F.struct(F.lit(c).alias("component"), F.get("_w", F.lit(k)).alias("coefficient")) for k, c in enumerate(columns)]]
    return model_table(spark, models, columns).select("fit", F.inline(F.array(*terms)))


def coefficient_stability(frame: DataFrame) -> DataFrame:
    """Coefficients of the full model on training and on holdout rows, and whether their signs agree."""
    rows = frame.where("role <> 'purge'").withColumn("fit", F.col("role"))
    own = coefficients(frame.sparkSession, fit_many(rows, {r: tuple(COMPONENTS) for r in ("train", "test")})).withColumnRenamed("fit", "role")
    other = own.where("component <> 'intercept'").select(F.when(F.col("role") == "train", "test").otherwise("train").alias("role"), "component", F.col("coefficient").alias("_c"))
    both = own.join(other, ["role", "component"], "left")
    return both.select("role", "component", "coefficient", (F.signum("coefficient") == F.signum("_c")).alias("sign_stable"))


def incremental_tests(frame: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """Logistic models of the anchor alone, with each other component, and of all; gain in holdout average precision."""
    specs = {f"{anchor}_only": (anchor,)} | {f"{anchor}_plus_{c}": (anchor, c) for c in COMPONENTS if c != anchor} | {"all_components": tuple(COMPONENTS)}
    rows = frame.where("role <> 'purge'").withColumn("fit", F.explode(F.array(*[F.lit(s) for s in specs])))
    learn = frame.where("role = 'train'").withColumn("fit", F.lit("train"))
    models = fit_many(learn, specs, samples=dict.fromkeys(specs, "train"))
    m = rank_metrics(with_probability(rows, models), ["fit", "role"])
    wide = m.groupBy("fit").agg(*[F.max(F.when(F.col("role") == r, F.col("average_precision"))).alias(f"{r}_average_precision") for r in ("train", "test")], F.max(F.when(F.col("role") == "test", F.col("roc_auc"))).alias("test_roc_auc"))
    used = frame.sparkSession.createDataFrame([(s, k, c) for s, own in specs.items() for k, c in enumerate(own)], "fit string, k int, component string")
    terms = coefficients(frame.sparkSession, models).join(used, ["fit", "component"])
    item = F.struct("component", F.round("coefficient", 6).alias("coefficient"))
    text = terms.groupBy("fit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "component"))), lambda x: x["component"]), "+").alias("features"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(item)))).alias("coefficients"))  # up to five terms
    base = wide.where(F.col("fit") == f"{anchor}_only").select(F.col("test_average_precision").alias("base"))
    out = wide.join(text, "fit").crossJoin(F.broadcast(base))  # one row
    return out.withColumn("gain", F.col("test_average_precision") - F.col("base")).drop("base").withColumnRenamed("fit", "specification")


def variance_inflation(correlations: DataFrame, columns: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Diagonal of the inverse correlation matrix of each sample."""
    rows = correlations.collect()  # samples x components squared
    out = []
    for role in sorted({r["role"] for r in rows}):
        m = np.eye(len(columns))
        for r in rows:
            if r["role"] == role and r["correlation"] is not None:
                m[columns.index(r["component_1"]), columns.index(r["component_2"])] = r["correlation"]
        out += [(role, c, float(v)) for c, v in zip(columns, np.diag(np.linalg.pinv(m)), strict=True)]
    return correlations.sparkSession.createDataFrame(out, "role string, component string, vif double")
