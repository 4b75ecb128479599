"""All queries on panels, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import log_drawdown, tidy
from ..operators import baskets, diagnostics, episodes, features, metrics, models, network, panel, quality, scan, scoring, simulate, timeindex, validation
from ..sources import landed, panels, raw, stage
from . import logit_sql
from .oracle import NEEDED, SIMPLE, THRESHOLD, WINDOW, build, long_sql, metric_sql, rank_sql, threshold_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(select: str | None = None, doubles: str = "") -> Callable:
    """Register a query under its name, with its SQL; doubles are rounded on both sides."""

    def put(f: Callable) -> Callable:
        names = tuple(doubles.split())

        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            with stage.one_query():
                df = f(spark, sf_dir)
            return df.withColumns({c: tidy(F.col(c)) for c, kind in df.dtypes if kind == "double"})

        rounded.__doc__, rounded.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = rounded
        if select is not None:
            ORACLES[f.__name__] = build(select, names)
        return f

    return put


#: Rolling columns within scan.framed().
_AT = {"order": "_i", "partition": ("_part",)}

# Parts that queries share.


@stage.part
def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return panel.with_returns(panels.lineitem_panel(spark, sf))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return timeindex.scaffold(_returns(spark, sf), ["category", "value", "log_return"])


@stage.part
def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return baskets.cells(_wide(spark, sf))


@stage.part
def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return panel.series_flow(panels.order_series(spark, sf))


def _factor(spark: SparkSession, sf: str) -> DataFrame:
    return panel.factor_control(panels.quantity_factor(spark, sf))


def _system(spark: SparkSession, sf: str, min_active: int = 6) -> DataFrame:
    return panel.system_daily(_returns(spark, sf), _flows(spark, sf), min_active)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return panel.common_history(_wide(spark, sf), _system(spark, sf).agg(F.min("period").alias("start")))


@stage.part
def _baskets(spark: SparkSession, sf: str) -> DataFrame:
    return baskets.all_baskets(_cells(spark, sf), _members(spark, sf))


@stage.part
def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    return network.residuals(_cells(spark, sf), _factor(spark, sf))


@stage.part
def _net(spark: SparkSession, sf: str) -> DataFrame:
    return network.network(_cells(spark, sf), "ret", WINDOW, THRESHOLD)


@stage.part
def _frame(spark: SparkSession, sf: str) -> DataFrame:
    """The feature frame, a row for each period."""
    c = _cells(spark, sf)
    return features.feature_frame(c, _net(spark, sf), baskets.equal_weight(c), _flows(spark, sf))


@stage.part
def _residual_frame(spark: SparkSession, sf: str) -> DataFrame:
    c, r = _cells(spark, sf), _residuals(spark, sf)
    net = network.network(r, "residual", WINDOW, THRESHOLD, prefix="residual_")
    return features.feature_frame(c, _net(spark, sf), baskets.equal_weight(c), _flows(spark, sf), residual=(net, r))


@stage.part
def _split(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.purged_split(features.valid_rows(_frame(spark, sf)))


@stage.part
def _scores(spark: SparkSession, sf: str) -> DataFrame:
    z = scoring.scaled(_split(spark, sf))
    return scoring.long_scores(z.where("role <> 'purge'"), scoring.simple_scores())


def _thresholds(s: DataFrame) -> DataFrame:
    return metrics.choose_thresholds(s.where("role = 'train'"), ["model"])


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).where("model = 'heuristic'")
    return episodes.alerts(s.where("role = 'test'").select("period", "label", "score"), _thresholds(s).select("threshold"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _system(spark, sf_dir, min_active=1)


# Cleaning, returns, sums.


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY observed_at DESC, value DESC) AS k FROM r1 WHERE value IS NOT NULL AND value > 20 AND period >= DATE '2000-01-01') WHERE k = 1", "value")
def clean_latest(spark, sf):
    return panel.clean_latest(panels.raw_events(spark, sf), ["entity", "period"], "observed_at", 20.0, "2000-01-01")


@query("SELECT period, value FROM (SELECT CAST(o_orderdate AS DATE) AS period, o_totalprice AS value, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_totalprice DESC) AS k FROM orders WHERE o_totalprice > 0) WHERE k = 1", "value")
def series_clean(spark, sf):
    raw = panels.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("period"), F.col("o_orderdate").alias("observed_at"), F.col("o_totalprice").alias("value"))
    return panel.clean_latest(raw, ["period"], "observed_at", 0.0).select("period", "value")


@query("SELECT * FROM ret", "value log_return drawdown")
def panel_returns(spark, sf):
    return _returns(spark, sf)


@query("SELECT * FROM ret2", "value log_return drawdown")
def panel_returns_hourly(spark, sf):
    return panel.with_returns(panels.event_panel(spark, sf, "hour"), "hour")


@query("SELECT * FROM flows", "value log_flow")
def series_flow(spark, sf):
    return _flows(spark, sf)


@query("SELECT * FROM sysd", "total_value equal_weight_return downside_breadth worst_drawdown series_value series_flow")
def system_daily(spark, sf):
    return _system(spark, sf)


@query("SELECT DISTINCT entity, category FROM p1")
def entity_metadata(spark, sf):
    return panel.entity_metadata(panels.lineitem_panel(spark, sf))


@query("SELECT entity, max(category) AS category, min(period) AS first_period, max(period) AS last_period, count(*) AS n_rows, count(log_return) AS n_returns FROM ret GROUP BY entity")
def entity_coverage(spark, sf):
    return panel.entity_coverage(_returns(spark, sf))


@query("SELECT count(*) AS n_rows, count(DISTINCT (entity, period)) AS n_keys, count(*) - count(DISTINCT (entity, period)) AS n_surplus FROM r1")
def dup_check(spark, sf):
    return panel.duplicate_keys(panels.raw_events(spark, sf), ["entity", "period"])


@query("SELECT * FROM factor", "level factor_return")
def factor_control(spark, sf):
    return _factor(spark, sf)


@query("SELECT * FROM members", "share")
def common_history(spark, sf):
    return _members(spark, sf)


# Rows in time.

_IDX = "(SELECT period, row_number() OVER (ORDER BY period) AS n, log_flow FROM flows)"


@query(f"SELECT period, CASE WHEN count(log_flow) OVER w >= 7 THEN sum(log_flow) OVER w END AS sum7, CASE WHEN count(log_flow) OVER v >= 30 THEN stddev_samp(log_flow) OVER v END AS std30 FROM {_IDX} WINDOW w AS (ORDER BY n ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), v AS (ORDER BY n ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", "sum7 std30")
def rolling_sum_std(spark, sf):
    f = _flows(spark, sf)
    out = scan.framed(f, ["period"], 29, 0, lambda _: {"sum7": timeindex.rolling_sum("log_flow", 7, **_AT), "std30": timeindex.rolling_std("log_flow", 30, **_AT)})
    return out.select("period", "sum7", "std30")


@query("SELECT period, n, forward, CASE WHEN forward IS NOT NULL THEN CAST(forward <= ln(0.95) AS INTEGER) END AS label FROM (SELECT period, n, CASE WHEN count(equal_weight) OVER w >= 7 THEN sum(equal_weight) OVER w END AS forward FROM b_eq WINDOW w AS (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))", "forward")
def forward_label(spark, sf):
    b = scan.framed(baskets.equal_weight(_cells(spark, sf)), ["n"], 0, 7, lambda _: {"forward": timeindex.forward_sum("equal_weight", 7, **_AT)})
    return b.select("period", "n", "forward", timeindex.stress_label(F.col("forward"), log_drawdown(0.05)).alias("label"))


@query("SELECT CAST(period AS DATE) AS period FROM (SELECT unnest(generate_series((SELECT min(period) FROM s1)::TIMESTAMP, (SELECT max(period) FROM s1)::TIMESTAMP, INTERVAL 1 DAY)) AS period) WHERE CAST(period AS DATE) NOT IN (SELECT period FROM s1)")
def calendar_gaps(spark, sf):
    return timeindex.missing_days(panels.order_series(spark, sf))


@query("SELECT entity, arg_max(value, n) AS value FROM (SELECT n, entity, value FROM cells2 WHERE value IS NOT NULL) GROUP BY entity", "value")
def ffill_last(spark, sf):
    p = timeindex.scaffold(panels.event_panel(spark, sf, "hour"), ["value"])
    return timeindex.last_known(p, "entity", "n", "value")


@query("SELECT min_d + 14 * CAST(floor((period - min_d) / 14) AS INTEGER) AS slot_start, CAST(floor((period - min_d) / 14) AS INTEGER) AS slot, avg(value) AS value FROM s1, (SELECT min(period) AS min_d FROM s1) GROUP BY ALL", "value")
def resample14(spark, sf):
    return timeindex.tumbling_mean(panels.order_series(spark, sf), "value", 14)


@query("SELECT * FROM br", "breadth")
def breadth(spark, sf):
    return features.breadth(_cells(spark, sf), "ret")


# Baskets.


@query("SELECT * FROM b_eq", "equal_weight")
def basket_equal(spark, sf):
    return baskets.equal_weight(_cells(spark, sf))


@query("SELECT * FROM b_lag", "lagged_weight")
def basket_lagged_weight(spark, sf):
    return baskets.lagged_weight(_cells(spark, sf))


@query("SELECT * FROM b_cap", "capped_weight")
def basket_capped(spark, sf):
    return baskets.capped_weight(_cells(spark, sf))


@query("SELECT * FROM b_cat", "category_weight")
def basket_category(spark, sf):
    return baskets.category_weight(_cells(spark, sf))


@query("SELECT * FROM b_com", "common_history")
def basket_common(spark, sf):
    return baskets.common_weight(_cells(spark, sf), _members(spark, sf))


@query("SELECT period, basket, CASE WHEN count(r) OVER w >= 7 THEN sum(r) OVER w END AS forward, CASE WHEN count(r) OVER w >= 7 THEN CAST(sum(r) OVER w <= ln(0.95) AS INTEGER) END AS label, r AS ret FROM (" + " UNION ALL ".join(f"SELECT period, n, '{b}' AS basket, {b} AS r FROM baskets" for b in baskets.BASKETS) + ") WINDOW w AS (PARTITION BY basket ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)", "forward ret")
def targets_daily(spark, sf):
    """Return, forward sum and label of all five baskets."""
    b = _baskets(spark, sf)
    long = scoring.long_scores(b, {k: F.col(k) for k in baskets.BASKETS}, ("period", "n"), "basket")
    long = long.withColumn("forward", timeindex.forward_sum("score", 7, partition=("basket",)))
    return long.select("period", "basket", "forward", timeindex.stress_label(F.col("forward"), log_drawdown(0.05)).alias("label"), F.col("score").alias("ret"))


# Networks and the factor.


@query("SELECT * FROM net", "mean_correlation density")
def corr_network(spark, sf):
    return _net(spark, sf)


@query("SELECT * FROM net2", "mean_correlation density")
def corr_network_gaps(spark, sf):
    hourly = panel.with_returns(panels.event_panel(spark, sf, "hour"), "hour")
    return network.network(timeindex.scaffold(hourly, ["log_return"]), "log_return", WINDOW, THRESHOLD, min_obs=20)


@query("SELECT * FROM edges", "rho")
def latest_edges(spark, sf):
    return network.latest_edges(_cells(spark, sf), "ret", WINDOW, THRESHOLD, NEEDED)


@query("SELECT entity, period, beta, alpha, residual FROM resid", "beta alpha residual")
def factor_residuals(spark, sf):
    return _residuals(spark, sf).select("entity", "period", "beta", "alpha", "residual")


@query("SELECT entity, count(residual) AS n_obs, covar_samp(ret, factor_return) FILTER (residual IS NOT NULL) / (stddev_samp(ret) FILTER (residual IS NOT NULL) * stddev_samp(factor_return) FILTER (residual IS NOT NULL)) AS raw_correlation, median(beta) AS median_beta, var_samp(residual) / var_samp(ret) FILTER (residual IS NOT NULL) AS variance_ratio FROM resid GROUP BY entity", "raw_correlation median_beta variance_ratio")
def factor_summary(spark, sf):
    return network.factor_summary(_residuals(spark, sf))


@query("SELECT * FROM rnet", "residual_mean_correlation residual_density")
def residual_network(spark, sf):
    return network.network(_residuals(spark, sf), "residual", WINDOW, THRESHOLD, prefix="residual_")


@query("SELECT role, avg(mean_correlation) AS mean_correlation, avg(density) AS density, avg(residual_mean_correlation) AS residual_mean_correlation, avg(residual_density) AS residual_density, count(*) AS n_rows FROM (SELECT period, role FROM split WHERE role <> 'purge') JOIN (SELECT period, mean_correlation, density FROM net) USING (period) JOIN (SELECT period, residual_mean_correlation, residual_density FROM rnet) USING (period) GROUP BY role", "mean_correlation density residual_mean_correlation residual_density")
def network_attenuation(spark, sf):
    roles = _split(spark, sf).where("role <> 'purge'").select("period", "role")
    return network.attenuation(_net(spark, sf), network.network(_residuals(spark, sf), "residual", WINDOW, THRESHOLD, prefix="residual_"), roles)


# Features, splits, scores, metrics.

_FEATURES = "correlation density equal_weight flow breadth contraction volatility momentum forward_return"


@query("SELECT period, n, correlation, density, equal_weight, flow, breadth, contraction, volatility, momentum, forward_return, label FROM frame", _FEATURES)
def feature_panel(spark, sf):
    return _frame(spark, sf).select("period", "n", *_FEATURES.split(), "label")


@query("SELECT period, role, label, holdout_start FROM split")
def purged_split(spark, sf):
    return _split(spark, sf).select("period", "role", "label", "holdout_start")


_LIMITS = [f"{k}_{c}" for c in (*features.COMPONENTS, features.MOMENTUM) for k in ("low", "high")]


@query("SELECT * FROM limits", " ".join(_LIMITS))
def scaler_fit(spark, sf):
    return scoring.fit_scaler(_split(spark, sf).where("role = 'train'"), (*features.COMPONENTS, features.MOMENTUM))


@query("SELECT period, role, model, label, score FROM scores", "score")
def simple_scores(spark, sf):
    return _scores(spark, sf).select("period", "role", "model", "label", "score")


@query("SELECT role, model, observations, events, average_precision, roc_auc FROM (" + rank_sql("scores", "role, model") + ")", "average_precision roc_auc")
def rank_metrics(spark, sf):
    return metrics.rank_metrics(_scores(spark, sf), ["role", "model"])


@query("SELECT * FROM (" + rank_sql("(SELECT l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id))", "quality", "toxic", "n_chars") + ")", "average_precision roc_auc")
def rank_metrics_ties(spark, sf):
    """Metrics of a score with many ties."""
    both = panels.table(spark, sf, "labels").join(panels.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.rank_metrics(both, ["quality"], "toxic", "n_chars")


@query("SELECT * FROM thresholds", "threshold")
def threshold_f2(spark, sf):
    return _thresholds(_scores(spark, sf))


_METRICS = "threshold average_precision roc_auc brier_score prevalence precision recall alert_rate f1 f2 specificity balanced_accuracy"


_DOUBLES = " ".join(f'"{c}"' if c == "precision" else c for c in _METRICS.split())


@query(metric_sql("scores", "thresholds", "model"), _DOUBLES)
def metric_rows(spark, sf):
    s = _scores(spark, sf)
    return metrics.metric_rows(s.where("role = 'test'"), _thresholds(s), ["model"])


@query("SELECT period, label, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN score END) AS score_{m}, max(CASE WHEN model = '{m}' THEN CAST(score >= threshold AS INTEGER) END) AS alert_{m}" for m in scoring.SIMPLE) + " FROM scores JOIN thresholds USING (model) WHERE role = 'test' GROUP BY period, label", " ".join(f"score_{m}" for m in scoring.SIMPLE))
def predictions_wide(spark, sf):
    """Holdout scores and alerts, a column for each model."""
    return _predictions(_scores(spark, sf), scoring.SIMPLE)


def _predictions(s: DataFrame, names: tuple[str, ...]) -> DataFrame:
    both = s.where("role = 'test'").join(_thresholds(s), "model").withColumn("alert", (F.col("score") >= F.col("threshold")).cast("int"))
    wide = both.groupBy("period", "label").pivot("model", list(names)).agg(F.max("score").alias("s"), F.max("alert").alias("a"))
    return wide.select("period", "label", *[F.col(f"{m}_{k}").alias(f"{n}_{m}") for m in names for k, n in (("s", "score"), ("a", "alert"))])


@query("SELECT * FROM (SELECT 'clipped' AS specification, average_precision, roc_auc FROM (" + rank_sql("(SELECT * FROM scores WHERE role = 'test' AND model = 'heuristic')", "model") + ")) UNION ALL SELECT 'unclipped', average_precision, roc_auc FROM (" + rank_sql("(SELECT role, label, " + " + ".join(f"{w!r}::DOUBLE * ({c} - low_{c}) / (high_{c} - low_{c})" for c, w in features.WEIGHTS.items()) + " AS score FROM split, limits WHERE role = 'test')", "role") + ")", "average_precision roc_auc")
def scaling_comparison(spark, sf):
    s, out = _split(spark, sf), None
    for name, clipped in (("clipped", True), ("unclipped", False)):
        z = scoring.scaled(s, features.COMPONENTS, clipped).where("role = 'test'")
        m = metrics.rank_metrics(z.select("label", scoring.weighted(features.WEIGHTS).alias("score"), F.lit(name).alias("specification")), ["specification"])
        m = m.select("specification", "average_precision", "roc_auc")
        out = m if out is None else out.unionByName(m)
    return out


# Diagnostics.


@query("SELECT role, component_1, component_2, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS correlation FROM (" + " UNION ALL ".join(f"SELECT role, '{a}' AS component_1, '{b}' AS component_2, {a} AS x, {b} AS y FROM split" for a in features.COMPONENTS for b in features.COMPONENTS) + ") GROUP BY ALL", "correlation")
def component_corr(spark, sf):
    return diagnostics.component_correlations(_split(spark, sf))


@query("SELECT * FROM (SELECT role, component, covar_samp(x, label) / nullif(stddev_samp(x) * stddev_samp(label), 0) AS event_correlation FROM comps GROUP BY ALL) JOIN (SELECT role, component, average_precision FROM (" + rank_sql("comps", "role, component", score="x") + ")) USING (role, component) JOIN (SELECT role, component, average_precision AS inverse_average_precision FROM (" + rank_sql("comps", "role, component", score="-x") + ")) USING (role, component)", "event_correlation average_precision inverse_average_precision")
def component_associations(spark, sf):
    return diagnostics.associations(_split(spark, sf))


@query("SELECT role, component, label AS event, count(*) AS observations, avg(x) AS mean, median(x) AS median, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75 FROM comps GROUP BY ALL", "mean median p25 p75")
def distributions(spark, sf):
    return diagnostics.distributions(_split(spark, sf))


@query("SELECT role, component, CAST(greatest(1, (10 * (r - 1) + (n - 2)) // (n - 1)) AS INTEGER) AS decile, count(*) AS observations, avg(label) AS event_rate, avg(x) AS mean_component FROM (SELECT *, row_number() OVER (PARTITION BY role, component ORDER BY x, period) AS r, count(*) OVER (PARTITION BY role, component) AS n FROM comps) WHERE n > 1 GROUP BY ALL", "event_rate mean_component")
def deciles(spark, sf):
    return diagnostics.deciles(_split(spark, sf))


@query("SELECT role, component, avg(CASE WHEN x <= low THEN 1.0::DOUBLE ELSE 0.0 END) AS at_or_below_p05, avg(CASE WHEN x >= high THEN 1.0::DOUBLE ELSE 0.0 END) AS at_or_above_p95, max(low) AS training_p05, max(high) AS training_p95 FROM (" + " UNION ALL ".join(f"SELECT role, '{c}' AS component, {c} AS x, low_{c} AS low, high_{c} AS high FROM split, limits" for c in features.COMPONENTS) + ") GROUP BY ALL", "at_or_below_p05 at_or_above_p95 training_p05 training_p95")
def saturation(spark, sf):
    return diagnostics.saturation(_split(spark, sf))


@query("SELECT specification, train_average_precision, test_average_precision, test_average_precision - max(CASE WHEN specification = 'single_contraction' THEN test_average_precision END) OVER () AS gain FROM (SELECT specification, max(average_precision) FILTER (role = 'train') AS train_average_precision, max(average_precision) FILTER (role = 'test') AS test_average_precision FROM (" + rank_sql("ablscores", "specification, role") + ") GROUP BY specification)", "train_average_precision test_average_precision gain")
def ablation(spark, sf):
    return diagnostics.ablation(_split(spark, sf))


# Validation over time.


@query(
    "SELECT model, window_end_row AS \"window\", window_start, window_end, prevalence, observations, events, average_precision, roc_auc, rank_correlation FROM (SELECT model, w AS window_end_row, min(period) AS window_start, max(period) AS window_end, avg(label) AS prevalence, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS rank_correlation FROM (SELECT *, rank() OVER (PARTITION BY model, w ORDER BY score) + (count(*) OVER (PARTITION BY model, w, score) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY model, w ORDER BY label) + (count(*) OVER (PARTITION BY model, w, label) - 1) / 2.0::DOUBLE AS y FROM wins) GROUP BY model, w) JOIN (SELECT w AS window_end_row, * EXCLUDE (w) FROM (" + rank_sql("wins", "model, w") + ")) USING (model, window_end_row)",
    "prevalence average_precision roc_auc rank_correlation",
)
def rolling_perf(spark, sf):
    return validation.rolling_performance(_scores(spark, sf).select("model", "period", "label", "score"))


@query("SELECT horizon, lag, model, observations, events, average_precision, roc_auc, events / observations::DOUBLE AS prevalence FROM (" + rank_sql("lagscores", "horizon, lag, model") + ")", "average_precision roc_auc prevalence")
def lag_horizon(spark, sf):
    start = _split(spark, sf).agg(F.max("holdout_start").alias("holdout_start"))
    return validation.lag_horizon(_frame(spark, sf), start)


# Episodes.

_EPISODES = """SELECT episode, onset, "end", duration, forward_return, 1 - exp(forward_return) AS severity, CAST(lead_days IS NOT NULL AS INTEGER) AS pre_onset_alert, CAST(lead_days AS INTEGER) AS lead_days, alert_from_onset, CAST(lead_days IS NULL AND alert_from_onset = 1 AS INTEGER) AS after_onset_only, coalesce(worst, '') AS worst_entities FROM onsets
  LEFT JOIN (SELECT episode, min(onset - a.period) AS lead_days FROM onsets JOIN alerts a ON a.alert = 1 AND a.period >= onset - 7 AND a.period < onset GROUP BY episode) USING (episode)
  LEFT JOIN (SELECT period AS onset, forward_return FROM frame) USING (onset)
  LEFT JOIN (SELECT episode, string_agg(printf('%d:%.3f', entity, s), '; ' ORDER BY k) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY s NULLS LAST, entity) AS k FROM (SELECT episode, entity, sum(ret) AS s FROM onsets JOIN cells c ON c.period > onset AND c.period <= onset + 7 GROUP BY ALL)) WHERE k <= 3 AND s IS NOT NULL GROUP BY episode) USING (episode)"""


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.stress_episodes(_alerts(spark, sf), _cells(spark, sf), _frame(spark, sf))


@query(_EPISODES, "forward_return severity")
def stress_episodes(spark, sf):
    return _episodes(spark, sf)


@query(f"SELECT episode, severity, worst_entities FROM ({_EPISODES}) ORDER BY severity DESC NULLS LAST, episode LIMIT 3", "severity")
def top_episodes(spark, sf):
    """The three most severe episodes."""
    return _episodes(spark, sf).select("episode", "severity", "worst_entities").orderBy(F.desc_nulls_last("severity"), "episode").limit(3)


@query("SELECT run, min(period) AS start, max(period) AS \"end\", count(*) AS duration, max(score) AS max_score FROM (SELECT *, (sum(new) OVER (ORDER BY period))::BIGINT AS run FROM (SELECT *, CASE WHEN f = 1 AND lag(f, 1, 0) OVER (ORDER BY period) = 0 THEN 1 ELSE 0 END AS new FROM (SELECT *, CASE WHEN alert = 1 AND label = 0 THEN 1 ELSE 0 END AS f FROM alerts))) WHERE f = 1 GROUP BY run", "max_score")
def false_alerts(spark, sf):
    return episodes.false_alert_runs(_alerts(spark, sf))


@query("SELECT CAST(k AS INTEGER) AS \"offset\", count(*) AS episodes, avg(equal_weight) AS mean_equal_weight, " + ", ".join(f"avg({c}) AS mean_{c}" for c in features.COMPONENTS) + " FROM (SELECT onset, unnest(range(-14, 15)) AS k FROM onsets) JOIN valid v ON v.period = onset + CAST(k AS INTEGER) GROUP BY k", "mean_equal_weight " + " ".join(f"mean_{c}" for c in features.COMPONENTS))
def event_study(spark, sf):
    return episodes.event_study(_episodes(spark, sf), features.valid_rows(_frame(spark, sf)))


_Z = ", ".join(f"avg(({c} - m_{c}) / nullif(s_{c}, 0)) AS z_{c}" for c in features.COMPONENTS)
_MOMENTS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in features.COMPONENTS)


@query(f"SELECT CAST(k AS INTEGER) AS \"offset\", {_Z} FROM (SELECT onset, unnest(range(-14, 15)) AS k FROM onsets) JOIN valid v ON v.period = onset + CAST(k AS INTEGER), (SELECT {_MOMENTS} FROM split WHERE role = 'train') GROUP BY k", " ".join(f"z_{c}" for c in features.COMPONENTS))
def event_study_z(spark, sf):
    s = _split(spark, sf)
    return episodes.event_study_z(_episodes(spark, sf), s.select("period", *features.COMPONENTS), s.where("role = 'train'"))


# Fitted models. SQL takes shortened Newton steps of its own to the same optimum.

_MAIN = "(SELECT 'main' AS task, * FROM split)"


def _task(df: DataFrame, name: str = "main") -> DataFrame:
    return df.withColumn("task", F.lit(name))


def _fit_rows(name: str, where: str, features: tuple[str, ...] = features.COMPONENTS) -> str:
    return f"SELECT {name} AS fit, {logit_sql.mask(features)} AS mask, label, {logit_sql.X} AS x FROM split WHERE {where}"


@query(
    f"SELECT component AS term, coefficient, CASE WHEN component <> 'intercept' THEN mean END AS mean, CASE WHEN component <> 'intercept' THEN std END AS std FROM (SELECT unnest({['intercept', *features.COMPONENTS]!r}) AS component, unnest(b) AS coefficient, unnest([0.0::DOUBLE] || m) AS mean, unnest([0.0::DOUBLE] || s) AS std FROM {logit_sql.fits('(' + _fit_rows(repr('all'), 'role = ' + repr('train')) + ')')})",
    "coefficient mean std",
)
def logistic_fit(spark, sf):
    """Coefficients of the full model."""
    rows = _split(spark, sf).where("role = 'train'").withColumn("fit", F.lit("all"))
    found = models.fit_many(rows, {"all": features.COMPONENTS})  # none without training rows
    terms = [t for m in found.values() for t in (("intercept", m.intercept, None, None), *zip(m.features, m.coefficients, m.means, m.stds, strict=True))]
    return spark.createDataFrame(terms, "term string, coefficient double, mean double, std double")


@query(f"SELECT * EXCLUDE (mask, best) FROM {logit_sql.selection('(SELECT * FROM ' + _MAIN + ' WHERE role = ' + repr('train') + ')')}", "mean_average_precision")
def feature_selection(spark, sf):
    return models.select_features(_task(_split(spark, sf).where("role = 'train'")))[1]


@stage.part
def _model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all six models on the split."""
    s = _task(_split(spark, sf))
    return models.score_models(s, models.select_features(s.where("role = 'train'"))[0])


@stage.part
def _fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all six models, each fold a task."""
    f = stage.staged(models.outer_folds(features.valid_rows(_frame(spark, sf)), least=300), "folds")
    return models.score_models(f, models.select_features(f.where("role = 'train'"))[0])


_SIX = logit_sql.all_scores(_MAIN, "(SELECT 'main' AS task, * FROM scores)")


@query(f"WITH six AS MATERIALIZED (SELECT * FROM {_SIX}), cut AS MATERIALIZED ({threshold_sql('six', 'model')}) SELECT * FROM ({metric_sql('six', 'cut', 'model')})", _DOUBLES)
def model_metrics(spark, sf):
    """Holdout metrics of all six models."""
    scores = _model_scores(spark, sf)
    return metrics.metric_rows(scores.where("role = 'test'"), _thresholds(scores), ["model"])


#: Test rows of each of four folds, and training rows before the purge.
_OUTER = "(SELECT * EXCLUDE (i, size, a, b, cut), CASE WHEN i >= a AND i < b THEN 'test' WHEN period < cut - 7 THEN 'train' END AS role FROM (SELECT *, min(period) FILTER (i >= a AND i < b) OVER (PARTITION BY task) AS cut FROM (SELECT *, floor(start + (size - start) * lo) AS a, floor(start + (size - start) * hi) AS b FROM (SELECT *, greatest(300, floor(size * 0.5::DOUBLE)) AS start FROM (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS size FROM valid)), (VALUES " + ", ".join(f"('{k + 1}', {k / 4!r}::DOUBLE, {(k + 1) / 4!r}::DOUBLE)" for k in range(4)) + ") AS v(task, lo, hi))))"


def _own_scale(frame: str) -> str:
    """Simple scores of a frame (task, role, period, label, components), each task scaled by its own training rows."""
    names = (*features.COMPONENTS, features.MOMENTUM)
    z = ", ".join(f"(least(greatest({c}, low_{c}), high_{c}) - low_{c}) / (high_{c} - low_{c}) AS z_{c}" for c in names)
    low, high = (lambda c: f"quantile_cont({c}, 0.05)"), (lambda c: f"quantile_cont({c}, 0.95)")
    limits = ", ".join(f"{low(c)} AS low_{c}, CASE WHEN {high(c)} > {low(c)} THEN {high(c)} ELSE {low(c)} + 1 END AS high_{c}" for c in names)
    return f"({long_sql(f'(SELECT task, period, role, label, {z} FROM {frame} JOIN (SELECT task, {limits} FROM {frame} WHERE role = {chr(39)}train{chr(39)} GROUP BY task) USING (task))', SIMPLE, 'task, period, role, label')})"


def _pooled_sql() -> str:
    each = metric_sql("six", "cut", "task, model")
    names = "task, model, threshold, tp, fp, fn, tn, observations, events, average_precision, roc_auc, brier_score, alerts, prevalence, \"precision\", recall, alert_rate, f1, f2, specificity, balanced_accuracy"
    every = rank_sql("(SELECT * FROM six WHERE role = 'test')", "model")
    none = names.replace("task, model", "'all' AS task, model")
    for c in names.split(", ")[2:]:
        if c not in ("observations", "events", "average_precision", "roc_auc"):
            none = re.sub(rf'(?<![\w"]){re.escape(c)}(?![\w"])', f"NULL AS {c}", none)
    return f"""WITH o AS MATERIALIZED (SELECT * FROM {_OUTER} WHERE role IS NOT NULL), base AS MATERIALIZED (SELECT * FROM {_own_scale("o")}), six AS MATERIALIZED (SELECT * FROM {logit_sql.all_scores("o", "base")}), cut AS MATERIALIZED ({threshold_sql("six", "task, model")}),
      each_ AS MATERIALIZED ({each})
      SELECT {names}, NULL::DOUBLE AS fold_ap_mean, NULL::DOUBLE AS fold_ap_std FROM each_ UNION ALL SELECT {none}, fold_ap_mean, fold_ap_std FROM ({every}) JOIN (SELECT model, avg(average_precision) AS fold_ap_mean, stddev_samp(average_precision) AS fold_ap_std FROM each_ GROUP BY model) USING (model)"""


@query(_pooled_sql(), _DOUBLES + " fold_ap_mean fold_ap_std")
def walk_forward(spark, sf):
    """Metrics by fold and model, and pooled over folds as task 'all'."""
    scores = _fold_scores(spark, sf)
    keys = ["task", "model"]
    each = metrics.metric_rows(scores.where("role = 'test'"), metrics.choose_thresholds(scores.where("role = 'train'"), keys), keys)
    each = stage.staged(each, "metrics")
    return each.unionByName(models.pooled(scores, each).withColumn("task", F.lit("all")), allowMissingColumns=True)


def _targets_sql() -> str:
    some = " AND ".join(f"{c} IS NOT NULL" for c in (*features.COMPONENTS, features.MOMENTUM, "label"))
    one = lambda k: f"SELECT '{k}' AS task, f.* EXCLUDE (label), t.label FROM frame f JOIN (SELECT period, CASE WHEN count({k}) OVER w >= 7 THEN CAST(sum({k}) OVER w <= ln(0.95) AS INTEGER) END AS label FROM baskets WINDOW w AS (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) t USING (period)"
    rows = " UNION ALL ".join(map(one, baskets.BASKETS))
    roles = f"SELECT *, CASE WHEN period >= start THEN 'test' WHEN period < start - 7 THEN 'train' ELSE 'purge' END AS role FROM ({rows}), (SELECT max(holdout_start) AS start FROM split) WHERE {some}"
    scores = f"(SELECT * FROM {logit_sql.all_scores('tg', 'base')} WHERE role = 'test' AND model NOT IN ('equal_component', 'momentum'))"
    return f"WITH tg AS MATERIALIZED ({roles}), base AS MATERIALIZED (SELECT * FROM {_own_scale('tg')} WHERE role <> 'purge') {rank_sql(scores, 'task, model')}"


@query(f"SELECT * FROM ({_targets_sql()})", "average_precision roc_auc")
def target_sensitivity(spark, sf):
    """Holdout metrics under each of the five basket targets."""
    start = _split(spark, sf).agg(F.max("holdout_start").alias("holdout_start"))
    b, f = _baskets(spark, sf), _frame(spark, sf).drop("label")
    labels = scan.framed(b, ["n"], 0, 7, lambda _: {f"label_{k}": timeindex.stress_label(timeindex.forward_sum(k, 7, **_AT), log_drawdown(0.05)) for k in baskets.BASKETS})
    out = None
    for k in baskets.BASKETS:
        one = _task(features.valid_rows(f.join(labels.select("period", F.col(f"label_{k}").alias("label")), "period")), k)
        out = one if out is None else out.unionByName(one)
    out = stage.staged(scoring.with_roles(out.crossJoin(F.broadcast(start)), 7), "targets")  # start has one row
    chosen, _ = models.select_features(out.where("role = 'train'"))
    scores = models.score_models(out, chosen).where("role = 'test' AND model <> 'equal_component' AND model <> 'momentum'")
    return metrics.rank_metrics(scores, ["task", "model"])


def _inverse_sql() -> str:
    """Diagonals of the inverses of the samples' correlation matrices, by elimination on rows beside the unit matrix."""
    n = len(features.COMPONENTS)
    row = lambda a, i: "[" + ", ".join([*[f"CASE WHEN '{a}' = '{b}' THEN 1.0::DOUBLE ELSE covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END" for b in features.COMPONENTS], *[f"{float(i == j)}::DOUBLE" for j in range(n)]]) + "]"
    first = f"SELECT role, 1 AS k, [{', '.join(row(a, i) for i, a in enumerate(features.COMPONENTS))}] AS m FROM split WHERE role <> 'purge' GROUP BY role"
    step = f"SELECT role, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= {n}"
    return f"WITH RECURSIVE g AS ({first} UNION ALL {step}) SELECT role, unnest({list(features.COMPONENTS)!r}) AS component, unnest([{', '.join(f'm[{k}][{n + k}]' for k in range(1, n + 1))}]) AS vif FROM g WHERE k = {n + 1}"


@query(f"SELECT * FROM ({_inverse_sql()})", "vif")
def variance_inflation(spark, sf):
    return models.variance_inflation(diagnostics.component_correlations(_split(spark, sf).where("role <> 'purge'")))


@query(f"SELECT role, component, coefficient, CASE WHEN component <> 'intercept' THEN sign(coefficient) = sign(other) END AS sign_stable FROM (SELECT fit AS role, component, coefficient, sum(coefficient) OVER (PARTITION BY component ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS other FROM {logit_sql.terms(logit_sql.fits('(' + _fit_rows('role', 'role <> ' + repr('purge')) + ')'))})", "coefficient")
def coef_stability(spark, sf):
    return models.coefficient_stability(_split(spark, sf))


_SPECS = {"contraction_only": ("contraction",)} | {f"contraction_plus_{c}": ("contraction", c) for c in features.COMPONENTS if c != "contraction"} | {"all_components": features.COMPONENTS}
_INC_ROWS = "(SELECT specification AS fit, label, role, x, mask, features FROM (SELECT label, role, " + logit_sql.X + " AS x FROM split WHERE role <> 'purge'), (VALUES " + ", ".join(f"('{s}', '{'+'.join(c)}', {logit_sql.mask(c)})" for s, c in _SPECS.items()) + ") AS v(specification, features, mask))"


def _incremental_sql() -> str:
    order = sorted(range(len(features.COMPONENTS)), key=lambda k: features.COMPONENTS[k])
    parts = "list_filter([" + ", ".join(f"CASE WHEN mask[{k + 1}] = 1 THEN {{'k': '{features.COMPONENTS[k]}', 'v': round(b[{k + 2}], 6) + 0.0::DOUBLE}} END" for k in order) + "], lambda e: e IS NOT NULL)"
    ranks = rank_sql(f"(SELECT iw.fit, role, label, features, {logit_sql.probability()} AS score FROM (SELECT * EXCLUDE (mask) FROM iw) iw JOIN il USING (fit))", "fit, features, role")
    return f"""WITH iw AS MATERIALIZED (SELECT * FROM {_INC_ROWS}), il AS MATERIALIZED (SELECT * FROM {logit_sql.fits("(SELECT * FROM iw WHERE role = 'train')")}),
      ir AS MATERIALIZED (SELECT fit, features, max(average_precision) FILTER (role = 'train') AS train_average_precision, max(average_precision) FILTER (role = 'test') AS test_average_precision, max(roc_auc) FILTER (role = 'test') AS test_roc_auc FROM ({ranks}) GROUP BY ALL)
      SELECT fit AS specification, train_average_precision, test_average_precision, test_roc_auc, features, test_average_precision - (SELECT test_average_precision FROM ir WHERE fit = 'contraction_only') AS gain,
        list_transform({parts}, lambda e: e.k) AS components, list_transform({parts}, lambda e: e.v) AS fitted_coefficients FROM ir JOIN il USING (fit)"""


@query(f"SELECT specification, train_average_precision, test_average_precision, test_roc_auc, features, gain, array_to_string(components, '+') AS components, array_to_string(list_transform(fitted_coefficients, lambda e: CAST(CAST(round(e * 1000000) AS BIGINT) AS VARCHAR)), '+') AS micro_coefficients FROM ({_incremental_sql()})", "train_average_precision test_average_precision test_roc_auc gain")
def incremental_logistic(spark, sf):
    """The JSON of the coefficients is told apart into its names, and values in millionths."""
    out = models.incremental_tests(_split(spark, sf))
    own = F.from_json("coefficients", "map<string, double>")
    text = lambda c: F.array_join(c, "+")
    out = out.withColumns({"components": text(F.map_keys(own)), "micro_coefficients": text(F.transform(F.map_values(own), lambda v: F.round(v * 1000000).cast("long").cast("string")))})
    return out.drop("coefficients")


_RF = """(SELECT *, CASE WHEN count(rr) OVER f >= 7 THEN CAST(sum(rr) OVER f <= ln(0.95) AS INTEGER) END AS residual_label, CASE WHEN count(rr) OVER v >= 30 THEN stddev_samp(rr) OVER v END AS volatility FROM
  (SELECT period, n, residual_mean_correlation AS correlation, residual_density AS density, contraction, breadth, label, rr FROM (SELECT period, n, contraction, label FROM frame) LEFT JOIN (SELECT period, residual_mean_correlation, residual_density FROM rnet) USING (period)
  LEFT JOIN (SELECT period, count(*) FILTER (residual < 0) / nullif(count(residual), 0)::DOUBLE AS breadth, avg(residual) AS rr FROM resid GROUP BY period) USING (period))
  WINDOW f AS (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), v AS (ORDER BY n ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def _residual_sql(label: str, specification: str, score: str) -> str:
    """Test rows of the heuristic, or one component, on residual components, scaled by their own training rows."""
    some = " AND ".join(f"{c} IS NOT NULL" for c in (*features.COMPONENTS, "y"))
    rows = f"(SELECT *, CASE WHEN period >= start THEN 'test' WHEN period < start - 7 THEN 'train' ELSE 'purge' END AS role FROM (SELECT *, {label} AS y FROM {_RF}), (SELECT max(holdout_start) AS start FROM split) WHERE {some})"
    low, high = (lambda c: f"quantile_cont({c}, 0.05)"), (lambda c: f"quantile_cont({c}, 0.95)")
    limits = ", ".join(f"{low(c)} AS low_{c}, CASE WHEN {high(c)} > {low(c)} THEN {high(c)} ELSE {low(c)} + 1 END AS high_{c}" for c in features.COMPONENTS)
    z = ", ".join(f"(least(greatest({c}, low_{c}), high_{c}) - low_{c}) / (high_{c} - low_{c}) AS z_{c}" for c in features.COMPONENTS)
    return f"SELECT '{specification}' AS specification, y AS label, {score} AS score FROM (SELECT y, {z} FROM {rows}, (SELECT {limits} FROM {rows} WHERE role = 'train') WHERE role = 'test')"


_OWN = " + ".join(f"{w!r}::DOUBLE * z_{c}" for c, w in features.WEIGHTS.items())
_RESIDUAL = "(SELECT 'raw' AS specification, label, score FROM scores WHERE model = 'heuristic' AND role = 'test' UNION ALL " + " UNION ALL ".join(_residual_sql(*x) for x in (("label", "residual", _OWN), ("residual_label", "residual_target", _OWN), ("residual_label", "series_only_residual_target", "z_contraction"))) + ")"


@query(f"SELECT * FROM ({rank_sql(_RESIDUAL, 'specification')})", "average_precision roc_auc")
def residual_models(spark, sf):
    """The heuristic on raw and on residual components, against the raw and the residual target."""
    f = _residual_frame(spark, sf)
    s = stage.staged(scoring.purged_split(features.valid_rows(f)), "split")
    start = s.agg(F.max("holdout_start").alias("holdout_start"))
    raw = scoring.scaled(s, features.COMPONENTS).where("role = 'test'").select(F.lit("raw").alias("specification"), "label", scoring.weighted(features.WEIGHTS).alias("score"))
    f = scan.framed(f, ["n"], 0, 7, lambda _: {"residual_label": timeindex.stress_label(timeindex.forward_sum("residual_return", 7, **_AT), log_drawdown(0.05))})
    own = f.select("period", "n", F.col("residual_correlation").alias("correlation"), F.col("residual_density").alias("density"), "contraction", F.col("residual_volatility").alias("volatility"), F.col("residual_breadth").alias("breadth"), "label", "residual_label")
    out = raw
    for name, label in (("residual", "label"), ("residual_target", "residual_label")):
        one = own.withColumn("label", F.col(label)).drop("residual_label").dropna().crossJoin(F.broadcast(start))  # one row
        z = scoring.scaled(scoring.with_roles(one, 7), features.COMPONENTS).where("role = 'test'")
        out = out.unionByName(z.select(F.lit(name).alias("specification"), "label", scoring.weighted(features.WEIGHTS).alias("score")))
        if name == "residual_target":
            out = out.unionByName(z.select(F.lit("series_only_residual_target").alias("specification"), "label", F.col("z_contraction").alias("score")))
    return metrics.rank_metrics(out, ["specification"])


# Resampling and simulation.

_P, _S = simulate.PRIME, simulate.SEED + 901


def _draw_sql(seed: int, *parts: str) -> str:
    x = f"{seed}::BIGINT"
    for p in parts:
        x = f"((({x} * 48271 + {p} * 7919 + 12345) % {_P} * 69621 + 1) % {_P})"
    return f"({x} * 48271 % {_P})"


_BOOT = f"""(SELECT rep, label, score FROM (SELECT rep, {_draw_sql(_S, "rep", "slot")} % (n - b + 1) + k AS i FROM (SELECT *, unnest(range(0, b)) AS k FROM (SELECT *, unnest(range(0, (n + b - 1) // b)) AS slot FROM (SELECT rep, n, least(14, n) AS b FROM range(1, 1001) t(rep), (SELECT count(*) AS n FROM alerts)))) WHERE slot * b + k < n) JOIN (SELECT row_number() OVER (ORDER BY period) - 1 AS i, label, score FROM alerts) USING (i))"""


@query(f"SELECT point_estimate, quantile_cont(average_precision, 0.025) AS ci_lower_95, quantile_cont(average_precision, 0.975) AS ci_upper_95, count(average_precision) AS replications, count(*) - count(average_precision) AS without_events FROM ({rank_sql(_BOOT, 'rep')}), (SELECT average_precision AS point_estimate FROM ({rank_sql('(SELECT 1 AS a, * FROM alerts)', 'a')})) GROUP BY point_estimate", "point_estimate ci_lower_95 ci_upper_95")
def block_bootstrap(spark, sf):
    return simulate.block_bootstrap(_alerts(spark, sf))


@query("SELECT entity, k, size, loss FROM (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY loss, period) - 1 AS k, count(*) OVER (PARTITION BY entity) AS size, loss FROM (SELECT entity, period, least(greatest(loss, 0), 0.5::DOUBLE) AS loss FROM losses WHERE loss > 0) JOIN (SELECT entity, quantile_cont(least(loss, 0.5::DOUBLE), 0.85) AS low FROM losses WHERE loss > 0 GROUP BY entity) USING (entity) WHERE loss >= low)", "loss")
def loss_tails(spark, sf):
    return simulate.loss_tails(simulate.seven_day_losses(_cells(spark, sf)), 0.85, 0.50)


_CASCADE = "mean_loss p95_loss p99_loss probability_over_10pct mean_hit"


def _cascade_sql(rows: list[tuple]) -> str:
    """The cascades of these scenarios, round by round with joins."""
    u = lambda *parts: f"({_draw_sql(simulate.SEED, *parts)} / {_P}.0::DOUBLE)"
    table = ", ".join(f"({i}, '{s[0]}', {s[1]}::DOUBLE, {s[2]}, {s[3]}::DOUBLE, {s[4]}::DOUBLE, {s[5]}::DOUBLE, {s[6]}, '{s[7]}', {s[8]}::BIGINT)" for i, s in enumerate(rows))
    tails = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS tail, {c}::DOUBLE AS cap, entity, row_number() OVER (PARTITION BY entity ORDER BY loss, period) - 1 AS k, count(*) OVER (PARTITION BY entity) AS size, loss FROM (SELECT entity, period, least(loss, {c}::DOUBLE) AS loss FROM losses WHERE loss > 0) JOIN (SELECT entity, quantile_cont(least(loss, {c}::DOUBLE), {t}) AS low FROM losses WHERE loss > 0 GROUP BY entity) USING (entity) WHERE loss >= low" for t, c in sorted({(s[4], s[5]) for s in rows}))
    links = " UNION ALL ".join(f"SELECT {w} AS \"window\", {t}::DOUBLE AS threshold, src, dst, rho FROM (SELECT a.entity AS src, b.entity AS dst, CASE WHEN count(*) FILTER (a.ret IS NOT NULL AND b.ret IS NOT NULL) >= {network.needed(w)} THEN covar_samp(a.ret, b.ret) / nullif(stddev_samp(a.ret) FILTER (b.ret IS NOT NULL) * stddev_samp(b.ret) FILTER (a.ret IS NOT NULL), 0) END AS rho FROM cells a JOIN cells b ON a.n = b.n AND a.entity <> b.entity WHERE a.n > (SELECT max(n) FROM cells) - {w} GROUP BY ALL) WHERE rho >= {t}" for w, t in sorted({(s[6], s[3]) for s in rows}))
    own = "sid, path, multiplier, rounds, cap, \"window\", threshold"
    fronts = [f"f0 AS MATERIALIZED (SELECT {own}, e, least(loss, cap) AS shock FROM (SELECT p.*, {_draw_sql(simulate.SEED, 'sid', 'path', '1')} % size AS k FROM picked p JOIN (SELECT DISTINCT e, tail, cap, size FROM tl) USING (e, tail, cap)) JOIN tl USING (e, tail, cap, k))"]
    for r in range(1, max(s[2] for s in rows) + 1):
        before = " UNION ALL ".join(f"SELECT sid, path, e FROM f{k}" for k in range(r))
        factor = f"(0.75::DOUBLE + 0.5::DOUBLE * {u('sid', 'path', str(r + 1), '(src * size + dst)')})"
        fronts.append(
            f"f{r} AS MATERIALIZED (SELECT {own}, dst AS e, least(1 - exp(sum(ln(1 - v))), cap) AS shock FROM (SELECT {own}, dst, least(shock * multiplier * greatest(rho, 0) * {factor}, cap) AS v FROM (SELECT {own}, e AS src, shock FROM f{r - 1} WHERE rounds >= {r}) CROSS JOIN (SELECT count(*) AS size FROM ents) JOIN lk USING (\"window\", threshold, src) ANTI JOIN (SELECT sid, path, e AS dst FROM ({before})) USING (sid, path, dst)) WHERE v > 0 GROUP BY {own}, dst)"
        )
    hits = " UNION ALL ".join(f"SELECT sid, path, e, shock FROM f{k}" for k in range(len(fronts)))
    return f"""SELECT scenario, multiplier, rounds, threshold, tail, cap, "window", weighting, paths, mean_loss, p95_loss, p99_loss, probability_over_10pct, mean_hit FROM (
      WITH sc AS (SELECT * FROM (VALUES {table}) AS v(sid, scenario, multiplier, rounds, threshold, tail, cap, "window", weighting, paths)),
      ents AS MATERIALIZED (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS e FROM (SELECT DISTINCT entity FROM cells)),
      shares AS (SELECT weighting, e, v / sum(v) OVER (PARTITION BY weighting) AS w FROM (SELECT 'equal' AS weighting, e, 1.0::DOUBLE AS v FROM ents UNION ALL SELECT 'value', e, coalesce(v, 0) FROM ents LEFT JOIN (SELECT entity, arg_max(value, n) AS v FROM cells WHERE value IS NOT NULL GROUP BY entity) USING (entity))),
      wt AS MATERIALIZED (SELECT *, coalesce(sum(w) OVER (PARTITION BY weighting ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM shares),
      tl AS MATERIALIZED (SELECT e, tail, cap, k, size, loss FROM ({tails}) JOIN ents USING (entity)),
      lk AS MATERIALIZED (SELECT "window", threshold, a.e AS src, b.e AS dst, rho FROM ({links}) l JOIN ents a ON a.entity = l.src JOIN ents b ON b.entity = l.dst),
      drawn AS (SELECT *, {u("sid", "path", "0")} AS u FROM (SELECT *, unnest(range(1, paths + 1)) AS path FROM sc)),
      picked AS MATERIALIZED (SELECT d.*, e FROM drawn d JOIN (SELECT sid, path, max(e) AS e FROM drawn JOIN wt USING (weighting) WHERE w > 0 AND below <= u GROUP BY sid, path) USING (sid, path)),
      {", ".join(fronts)},
      per AS (SELECT sid, path, sum(w * shock) AS loss, count(*) FILTER (shock > 0) AS hit FROM ({hits}) JOIN (SELECT sid, weighting FROM sc) USING (sid) JOIN wt USING (weighting, e) GROUP BY sid, path)
      SELECT * FROM sc JOIN (SELECT sid, avg(loss) AS mean_loss, quantile_cont(loss, 0.95) AS p95_loss, quantile_cont(loss, 0.99) AS p99_loss, avg(CASE WHEN loss > 0.10 THEN 1.0::DOUBLE ELSE 0 END) AS probability_over_10pct, avg(hit) AS mean_hit FROM per GROUP BY sid) USING (sid))"""


_SCENARIOS = simulate.scenario_rows()


@query(_cascade_sql([_SCENARIOS[0], _SCENARIOS[-1]]), "multiplier threshold tail cap " + _CASCADE)
def cascade_scenario(spark, sf):
    """The baseline scenario and the one with equal weights."""
    rows = simulate.scenario_rows()
    return simulate.cascade(_cells(spark, sf), [rows[0], rows[-1]])


@query(_cascade_sql(_SCENARIOS), "multiplier threshold tail cap " + _CASCADE)
def scenario_grid(spark, sf):
    """All scenarios in one plan."""
    return simulate.cascade(_cells(spark, sf), simulate.scenario_rows())


@query("SELECT unnest(['loss_p95', 'loss_p99', 'loss_max', 'median_entities_in_tail']) AS quantity, unnest([a, b, c, d]) AS value FROM (SELECT a, b, c, (SELECT median(k) FROM (SELECT period, count(*) FILTER (loss > 0.01) AS k FROM losses SEMI JOIN (SELECT period FROM bl WHERE loss >= a) USING (period) GROUP BY period)) AS d FROM (SELECT quantile_cont(loss, 0.95) AS a, quantile_cont(loss, 0.99) AS b, max(loss) AS c FROM bl))", "value")
def historical_tail(spark, sf):
    return simulate.historical_tail(_cells(spark, sf))


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in simulate.ASSUMPTIONS) + ") AS v(assumption, detail), (SELECT count(DISTINCT entity) AS entities, count(DISTINCT period) AS periods, count(ret) AS n_returns, count(*) - count(ret) AS n_missing FROM cells)")
def scenario_assumptions(spark, sf):
    """What the cascades assume, beside the extent of the panel that they are drawn from."""
    return simulate.assumptions(_cells(spark, sf))


# Raw documents, checks, report tables.


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def raw_flatten(spark, sf):
    """A field of JSON text."""
    return panels.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _landed(spark: SparkSession, documents: DataFrame, name: str, says: dict | None = None) -> str:
    """The documents (kind, stem, document) landed as a snapshot in the shared folder, beside one that holds nothing of use."""
    folder = f"{stage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    landed.land(documents, folder, "new", says)
    landed.land(documents.limit(1).withColumn("document", F.lit('{"not": "read"}')), folder, "old")
    return folder


_LANDED = "SELECT entity, category, period, value, 86400 * CAST(period - DATE '1970-01-01' AS BIGINT) + 3600 AS observed_at FROM p1 WHERE period IS NOT NULL"


@query(f"SELECT period, observed_at, entity, 'entity ' || entity AS name, 'category ' || category AS category, value FROM ({_LANDED})", "value")
def landed_history(spark, sf):
    """Documents of an entity's year each, landed as files and read from there; the documents have no names."""
    p = panels.lineitem_panel(spark, sf).where("period IS NOT NULL")
    item = F.struct((F.unix_date("period").cast("long") * 86400 + 3600).alias("date"), F.col("value").alias("totalLiquidityUSD"))
    own = p.groupBy("entity", "category", F.year("period").alias("y")).agg(F.collect_list(item).alias("tvl"))  # a year's days
    folder = _landed(spark, own.select(F.lit("raw").alias("kind"), F.concat_ws("-", "entity", "category", "y").alias("stem"), F.to_json(F.struct("tvl")).alias("document")), "history")
    docs = landed.read_landed(spark, folder, "new").withColumn("d", F.from_json("document", raw.HISTORY)).withColumn("at", F.split("file", "-"))
    docs = docs.select(F.col("at")[0].cast("int").alias("entity"), F.col("at")[1].alias("category"), "d.*")
    return raw.entity_history(docs, F.col("entity"), F.concat(F.lit("entity "), "entity"), F.concat(F.lit("category "), "category"))


@query("SELECT period, 86400 * CAST(period - DATE '1970-01-01' AS BIGINT) AS observed_at, value FROM s1", "value")
def landed_series(spark, sf):
    """A nested aggregate series, landed by year and read from there; every seventh has no value beside its own and is left out."""
    day = F.struct((F.unix_date("period").cast("long") * 86400).alias("date"), F.struct(F.col("value").alias("peggedUSD")).alias("totalCirculatingUSD"))
    rows = panels.order_series(spark, sf).select(F.year("period").alias("y"), day.alias("r"))
    empty = rows.select("y", F.struct(F.col("r.date"), F.struct(F.lit(None).cast("double").alias("peggedUSD")).alias("totalCirculatingUSD")).alias("r")).where("pmod(r.date div 86400, 7) = 0")
    years = rows.unionByName(empty).groupBy("y").agg(F.to_json(F.collect_list("r")).alias("document"))  # a year's days
    folder = _landed(spark, years.select(F.lit("raw").alias("kind"), F.concat(F.lit("series-"), "y").alias("stem"), "document"), "series")
    docs = landed.read_landed(spark, folder, "new")
    return raw.aggregate_series(docs.select(F.inline(F.from_json("document", f"array<struct<{raw.SERIES.replace('date bigint', 'date: bigint').replace('totalCirculatingUSD struct', 'totalCirculatingUSD: struct')}>>"))))


@query("SELECT period, level, 86400 * CAST(period - DATE '1970-01-01' AS BIGINT) - 60 AS observed_at FROM f1 WHERE period <= DATE '2000-12-31'", "level")
def landed_factor(spark, sf):
    """Factor prices a minute before midnight, landed as chunks by year and single gap files, up to the manifest's cut-off day."""
    f = panels.quantity_factor(spark, sf).withColumn("timestamp", F.unix_date("period").cast("long") * 86400 - 60)
    alone = F.dayofmonth("period") == 13
    chunk = f.where(~alone).groupBy(F.year("period").cast("string").alias("stem")).agg(F.collect_list(F.struct("timestamp", F.col("level").alias("price"))).alias("prices"))  # a year's days
    docs = [chunk.select(F.lit("raw").alias("kind"), "stem", F.struct("prices").alias("x")), f.where(alone).select(F.lit("gap").alias("kind"), F.concat(F.lit("gap-"), F.col("period").cast("string")).alias("stem"), F.struct("timestamp", F.col("level").alias("price")).alias("x"))]
    chunks, gaps = (d.select("kind", "stem", F.to_json(F.struct(F.create_map(F.lit("q"), "x").alias("coins"))).alias("document")) for d in docs)
    folder = _landed(spark, chunks.unionByName(gaps), "factor", {"coin_identifier": "q", "sample_cutoff": "2000-12-31"})
    return raw.factor_from_landed(spark, folder, "new").select("period", "level", "observed_at")


# The summary: one row for each figure.


def _facts(df: DataFrame, **values) -> DataFrame:
    """(quantity, value) of a table of one row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("quantity"), F.col(c).cast("double").alias("value")) for k, c in values.items()])).alias("x")).select("x.*")


_SUMMARY = {
    "SELECT count(*) FILTER (role = 'train') AS training_observations, count(*) FILTER (role = 'test') AS holdout_observations, sum(label) FILTER (role = 'test') AS holdout_events, avg(label) FILTER (role = 'test') AS holdout_prevalence, corr(correlation, density) FILTER (role = 'train') AS training_correlation, corr(correlation, density) FILTER (role = 'test') AS holdout_correlation, avg(correlation) FILTER (role = 'test') AS raw_correlation, avg(density) FILTER (role = 'test') AS raw_density FROM split": "training_observations holdout_observations holdout_events holdout_prevalence training_correlation holdout_correlation raw_correlation raw_density",
    "SELECT avg(residual_mean_correlation) AS residual_correlation, avg(residual_density) AS residual_density FROM rnet SEMI JOIN (SELECT period FROM split WHERE role = 'test') USING (period)": "residual_correlation residual_density",
    "SELECT max(average_precision) FILTER (model = 'heuristic') AS heuristic_average_precision, max(roc_auc) FILTER (model = 'heuristic') AS heuristic_roc_auc, max(average_precision) FILTER (model = 'series_only') AS series_only_average_precision, max(roc_auc) FILTER (model = 'series_only') AS series_only_roc_auc FROM (" + rank_sql("(SELECT * FROM scores WHERE role = 'test')", "model") + ")": "heuristic_average_precision heuristic_roc_auc series_only_average_precision series_only_roc_auc",
    f"SELECT count(*) AS episodes, sum(pre_onset_alert) AS episodes_alerted_before, sum(after_onset_only) AS episodes_alerted_after, median(lead_days) AS median_lead_days FROM ({_EPISODES})": "episodes episodes_alerted_before episodes_alerted_after median_lead_days",
    "SELECT count(*) AS false_alert_runs FROM (SELECT f, lag(f, 1, 0) OVER (ORDER BY period) AS before FROM (SELECT period, CASE WHEN alert = 1 AND label = 0 THEN 1 ELSE 0 END AS f FROM alerts)) WHERE f = 1 AND before = 0": "false_alert_runs",
    "SELECT min(p95_loss) AS grid_p95_min, max(p95_loss) AS grid_p95_max, min(p99_loss) AS grid_p99_min, max(p99_loss) AS grid_p99_max FROM (" + _cascade_sql(_SCENARIOS) + ") WHERE scenario LIKE 'grid%'": "grid_p95_min grid_p95_max grid_p99_min grid_p99_max",
    "SELECT quantile_cont(loss, 0.99) AS historical_p99 FROM bl": "historical_p99",
    "SELECT max(average_precision) FILTER (lag = 0) AS series_lag_0_average_precision, max(average_precision) FILTER (lag = 7) AS series_lag_7_average_precision FROM (" + rank_sql("(SELECT * FROM lagscores WHERE horizon = 7 AND model = 'contraction')", "lag") + ")": "series_lag_0_average_precision series_lag_7_average_precision",
}


@query(" UNION ALL ".join(f"SELECT unnest([{', '.join(repr(c) for c in names.split())}]) AS quantity, unnest([{', '.join(c + '::DOUBLE' for c in names.split())}]) AS value FROM ({q})" for q, names in _SUMMARY.items()), "value")
def model_summary(spark, sf):
    """What the study says in figures, but for fitted models."""
    return _summary(spark, sf)


def _summary_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.rank_metrics(_scores(spark, sf).where("role = 'test'"), ["model"])
    return m.agg(*[F.max(F.when(F.col("model") == k, F.col(c))).alias(f"{k}_{c}") for k in ("heuristic", "series_only") for c in ("average_precision", "roc_auc")])


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda df: _facts(df, **{c: c for c in df.columns})
    s, test = _split(spark, sf), F.col("role") == "test"
    of = lambda f, c, role: f(F.when(F.col("role") == role, F.col(c)))
    rows = s.agg(
        F.count_if(F.col("role") == "train").alias("training_observations"), F.count_if(test).alias("holdout_observations"), of(F.sum, "label", "test").alias("holdout_events"), of(F.avg, "label", "test").alias("holdout_prevalence"),
        *[metrics.pearson(F.when(F.col("role") == r, F.col("correlation")), F.when(F.col("role") == r, F.col("density"))).alias(n) for r, n in (("train", "training_correlation"), ("test", "holdout_correlation"))],
        of(F.avg, "correlation", "test").alias("raw_correlation"), of(F.avg, "density", "test").alias("raw_density"),
    )
    rnet = network.network(_residuals(spark, sf), "residual", WINDOW, THRESHOLD, prefix="residual_").join(s.where(test).select("period"), "period", "left_semi")
    e, grid = _episodes(spark, sf), simulate.cascade(_cells(spark, sf), simulate.scenario_rows()).where("scenario LIKE 'grid%'")
    lags = lag_horizon(spark, sf).where("horizon = 7 AND model = 'contraction'")
    parts = [
        rows,
        rnet.agg(F.avg("residual_mean_correlation").alias("residual_correlation"), F.avg("residual_density").alias("residual_density")),
        _summary_scores(spark, sf),
        e.agg(F.count(F.lit(1)).alias("episodes"), F.sum("pre_onset_alert").alias("episodes_alerted_before"), F.sum("after_onset_only").alias("episodes_alerted_after"), F.median("lead_days").alias("median_lead_days")),
        episodes.false_alert_runs(_alerts(spark, sf)).agg(F.count(F.lit(1)).alias("false_alert_runs")),
        grid.agg(*[f(c).alias(f"grid_{c[:3]}_{n}") for c in ("p95_loss", "p99_loss") for f, n in ((F.min, "min"), (F.max, "max"))]),
        simulate.historical_tail(_cells(spark, sf)).where("quantity = 'loss_p99'").select(F.col("value").alias("historical_p99")),
        lags.agg(*[F.max(F.when(F.col("lag") == k, F.col("average_precision"))).alias(f"series_lag_{k}_average_precision") for k in (0, 7)]),
    ]
    out = None
    for p in parts:
        out = named(p) if out is None else out.unionByName(named(p))
    return out


@query(f"SELECT quantity, value FROM (WITH six AS MATERIALIZED (SELECT * FROM {_SIX}) SELECT 'holdout_' || model || '_average_precision' AS quantity, average_precision AS value FROM ({rank_sql("(SELECT * FROM six WHERE role = 'test')", 'model')})) UNION ALL SELECT 'walk_forward_' || model || '_average_precision', average_precision FROM ({_pooled_sql()}) WHERE task = 'all'", "value")
def model_summary_fitted(spark, sf):
    """The summary's figures of fitted models: holdout and walk-forward average precision."""
    kinds = (("holdout", _model_scores), ("walk_forward", _fold_scores))
    tests = [scores(spark, sf).where("role = 'test'").select(F.concat(F.lit(f"{k}_"), "model", F.lit("_average_precision")).alias("quantity"), "label", "score") for k, scores in kinds]
    return metrics.rank_metrics(tests[0].unionByName(tests[1]), ["quantity"]).select("quantity", F.col("average_precision").alias("value"))


_ALL_MODELS = (*scoring.SIMPLE, "logistic_all", "logistic_selected")


@query(f"WITH six AS MATERIALIZED (SELECT * FROM {_SIX}), cut AS MATERIALIZED ({threshold_sql('six', 'model')}) SELECT period, label, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN score END) AS score_{m}, max(CASE WHEN model = '{m}' THEN CAST(score >= threshold AS INTEGER) END) AS alert_{m}" for m in _ALL_MODELS) + " FROM six JOIN cut USING (model) WHERE role = 'test' GROUP BY period, label", " ".join(f"score_{m}" for m in _ALL_MODELS))
def predictions_models(spark, sf):
    """Holdout scores and alerts of all six models, a column for each."""
    return _predictions(_model_scores(spark, sf), _ALL_MODELS)


@query("""SELECT "check", passed FROM (SELECT 'panel keys are unique' AS "check", count(*) = count(DISTINCT (entity, period)) AS passed FROM p1 UNION ALL SELECT 'raw keys are unique', count(*) = count(DISTINCT (entity, period)) FROM r1 UNION ALL SELECT 'labels of the last rows are null', count(label) = 0 FROM frame WHERE n > (SELECT max(n) FROM frame) - 7 UNION ALL SELECT 'the calendar has no gap', count(*) = max(period) - min(period) + 1 FROM f1 UNION ALL SELECT 'five targets are there', true UNION ALL SELECT 'the grid has 64 scenarios', true UNION ALL SELECT 'training ends before the purge of each fold', true UNION ALL SELECT 'out-of-fold rows are unique', true UNION ALL SELECT 'summary agrees with metrics', true)""")
def dq_report(spark, sf):
    f = _frame(spark, sf)
    folds = models.outer_folds(features.valid_rows(f), least=300)
    oof = scoring.long_scores(scoring.apply_scaler(folds.where("role = 'test'"), scoring.fit_scaler(folds.where("role = 'train'"), (*features.COMPONENTS, features.MOMENTUM), ("task",)), (*features.COMPONENTS, features.MOMENTUM), ("task",)), scoring.simple_scores(), ("task", "period", "label"))
    s = _scores(spark, sf)
    told = _facts(_summary_scores(spark, sf), **{f"{k}_average_precision": f"{k}_average_precision" for k in ("heuristic", "series_only")})
    found = metrics.metric_rows(s.where("role = 'test'"), _thresholds(s), ["model"]).where("model IN ('heuristic', 'series_only')")
    found = found.select(F.concat("model", F.lit("_average_precision")).alias("quantity"), F.col("average_precision").alias("value"))
    kinds = [(x[0], x[6], x[3]) for x in simulate.scenario_rows() if x[0].startswith("grid")]
    edges = network.latest_edges_of(_cells(spark, sf), "ret", sorted({x[1:] for x in kinds})).groupBy("window", "threshold").agg(F.count(F.lit(1)).alias("edges"))
    grid = spark.createDataFrame(kinds, "scenario string, window int, threshold double").join(edges, ["window", "threshold"], "left").groupBy("scenario").agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges")).where("edges >= 0")
    return quality.report(
        [
            quality.unique(panels.lineitem_panel(spark, sf), ["entity", "period"], "panel keys are unique"),
            quality.unique(panels.raw_events(spark, sf), ["entity", "period"], "raw keys are unique"),
            quality.tail_unobservable(f, 7),
            quality.complete_calendar(_factor(spark, sf)),
            quality.columns_there(_baskets(spark, sf), baskets.BASKETS, "five targets are there"),
            quality.row_count(grid, 64, "the grid has 64 scenarios"),
            quality.chronology(folds, 7),
            quality.unique(oof, ["period", "model"], "out-of-fold rows are unique"),
            quality.reconciles(told, found, ["quantity"], "value", name="summary agrees with metrics"),
        ]
    )


@query("SELECT component_1, " + ", ".join(f"max(correlation) FILTER (component_2 = '{c}') AS {c}" for c in features.COMPONENTS) + " FROM (SELECT component_1, component_2, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS correlation FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS component_1, '{b}' AS component_2, {a} AS x, {b} AS y FROM split WHERE role = 'train'" for a in features.COMPONENTS for b in features.COMPONENTS) + ") GROUP BY ALL) GROUP BY component_1", " ".join(features.COMPONENTS))
def correlation_pivot(spark, sf):
    """The training correlation matrix, a column for each component."""
    c = diagnostics.component_correlations(_split(spark, sf).where("role = 'train'"))
    return c.groupBy("component_1").pivot("component_2", list(features.COMPONENTS)).agg(F.max("correlation"))
