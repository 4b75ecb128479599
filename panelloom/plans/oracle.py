"""The same queries in SQL: named subqueries that build on each other, for comparison on the same tables."""

from __future__ import annotations

import re

from ..operators.features import COMPONENTS, MOMENTUM, WEIGHTS

WINDOW, THRESHOLD = 60, 0.10
NEEDED = 45

_RET = """SELECT *, CASE WHEN date_diff('{unit}', lag(period) OVER w, period) = 1 AND lag(value) OVER w > 0 AND value > 0 THEN ln(value / lag(value) OVER w) END AS log_return,
  CASE WHEN max(value) OVER h > 0 THEN value / max(value) OVER h - 1 END AS drawdown FROM {panel}
  WINDOW w AS (PARTITION BY entity ORDER BY period), h AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""


def _rolling(f: str, c: str, size: int, part: str = "") -> str:
    w = f"({part} ORDER BY n ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {w} >= {size} THEN {f}({c}) OVER {w} END"


def _net(value: str, source: str, prefix: str = "") -> str:
    w = f"ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW"
    return f"""SELECT d.period, d.n, mean_correlation AS {prefix}mean_correlation, density AS {prefix}density, d.n_active AS {prefix}n_active, coalesce(k, 0) AS {prefix}n_pairs FROM
  (SELECT period, n, count(*) FILTER (c >= {NEEDED}) AS n_active FROM (SELECT *, count({value}) OVER (PARTITION BY entity ORDER BY n {w}) AS c FROM {source}) GROUP BY period, n) d
  LEFT JOIN (SELECT n, avg(rho) AS mean_correlation, avg(CASE WHEN rho >= {THRESHOLD} THEN 1.0::DOUBLE ELSE 0.0 END) AS density, count(rho) AS k FROM
    (SELECT n, CASE WHEN count(x) OVER q >= {NEEDED} THEN covar_samp(x, y) OVER q / nullif(stddev_samp(x) OVER q * stddev_samp(y) OVER q, 0) END AS rho FROM
      (SELECT a.n, a.entity AS src, b.entity AS dst, CASE WHEN b.{value} IS NOT NULL THEN a.{value} END AS x, CASE WHEN a.{value} IS NOT NULL THEN b.{value} END AS y FROM {source} a JOIN {source} b ON a.n = b.n AND a.entity < b.entity)
      WINDOW q AS (PARTITION BY src, dst ORDER BY n {w})) WHERE rho IS NOT NULL GROUP BY n) r USING (n) WHERE d.n >= {WINDOW}"""


def _roles(source: str, horizon: int = 7) -> str:
    return f"SELECT *, CASE WHEN period >= holdout_start THEN 'test' WHEN period < holdout_start - {horizon} THEN 'train' ELSE 'purge' END AS role FROM {source}"


def rank_sql(source: str, keys: str, label: str = "label", score: str = "score") -> str:
    """Tie-grouped average precision and rank-sum area, by keys."""
    return f"""SELECT {keys}, sum(n)::BIGINT AS observations, sum(p)::BIGINT AS events, sum(p * tp / k) / nullif(sum(p), 0) AS average_precision,
  (sum(p * (below + (n + 1) / 2.0::DOUBLE)) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / nullif(sum(p) * (sum(n) - sum(p)), 0) AS roc_auc FROM
  (SELECT {keys}, p, n, sum(p) OVER d AS tp, (sum(n) OVER d)::DOUBLE AS k, sum(n) OVER u - n AS below FROM
    (SELECT {keys}, {score} AS x, sum({label})::DOUBLE AS p, count(*)::DOUBLE AS n FROM {source} GROUP BY {keys}, x)
    WINDOW d AS (PARTITION BY {keys} ORDER BY x DESC), u AS (PARTITION BY {keys} ORDER BY x)) GROUP BY {keys}"""


def metric_sql(scores: str, thresholds: str, keys: str) -> str:
    """Nineteen metrics of the test rows at the thresholds, by keys."""
    return (
        f"""SELECT *, (recall + specificity) / 2 AS balanced_accuracy FROM (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1, coalesce(5 * "precision" * recall / nullif(4 * "precision" + recall, 0), 0) AS f2, (tp + fp) / observations::DOUBLE AS alert_rate, tn / nullif(tn + fp, 0)::DOUBLE AS specificity FROM
    (SELECT *, tp + fp AS alerts, events / observations::DOUBLE AS prevalence, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM (SELECT {keys}, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn, avg((least(greatest(score, 0), 1) - label) ** 2) AS brier_score FROM {scores} JOIN {thresholds} USING ({keys}) WHERE role = 'test' GROUP BY {keys}, threshold) JOIN ("""
        + rank_sql(f"(SELECT * FROM {scores} WHERE role = 'test')", keys)
        + f") USING ({keys})))"
    )


def threshold_sql(scores: str, keys: str) -> str:
    """(keys, threshold) of the training rows."""
    at = "[" + ", ".join(repr(i / 300) for i in range(301)) + "]"
    share = lambda a, b: f"coalesce(count(*) FILTER ({a}) / nullif(count(*) FILTER ({b}), 0)::DOUBLE, 0)"
    each = f"SELECT {keys}, x, count(*) FILTER (score >= x)::DOUBLE AS k, count(*)::DOUBLE AS n, {share('score >= x AND label = 1', 'score >= x')} AS pr, {share('score >= x AND label = 1', 'label = 1')} AS re FROM (SELECT DISTINCT {keys}, unnest(quantile_cont(score, {at})) AS x FROM {scores} WHERE role = 'train' GROUP BY {keys}) JOIN {scores} USING ({keys}) WHERE role = 'train' GROUP BY {keys}, x"
    return f"SELECT {keys}, coalesce(max(CASE WHEN k / n <= 0.30::DOUBLE THEN {{'f2': f2, 're': re, 'pr': pr, 'x': x}} END).x, max(x)) AS threshold FROM (SELECT *, coalesce(5 * pr * re / nullif(4 * pr + re, 0), 0) AS f2 FROM ({each})) GROUP BY {keys}"


def long_sql(source: str, scores: dict[str, str], keep: str, name: str = "model", value: str = "score") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{k}' AS {name}, {v} AS {value} FROM {source}" for k, v in scores.items())


def _z(c: str) -> str:
    return f"(least(greatest({c}, low_{c}), high_{c}) - low_{c}) / (high_{c} - low_{c}) AS z_{c}"


def _limits(columns: tuple[str, ...]) -> str:
    return ", ".join(f"quantile_cont({c}, 0.05) AS low_{c}, CASE WHEN quantile_cont({c}, 0.95) > quantile_cont({c}, 0.05) THEN quantile_cont({c}, 0.95) ELSE quantile_cont({c}, 0.05) + 1 END AS high_{c}" for c in columns)


def _wsum(w: dict[str, float]) -> str:
    return " + ".join(f"{v!r}::DOUBLE * z_{c}" for c, v in w.items())


_ALL = (*COMPONENTS, MOMENTUM)
HEURISTIC = _wsum(WEIGHTS)
SIMPLE = {"heuristic": HEURISTIC, "equal_component": "(" + " + ".join(f"z_{c}" for c in COMPONENTS) + ") / 5", "series_only": "z_contraction", MOMENTUM: f"z_{MOMENTUM}"}


def _ablation() -> dict[str, str]:
    out = {f"single_{c}": f"z_{c}" for c in COMPONENTS} | {f"contraction_plus_{c}": f"(z_contraction + z_{c}) / 2" for c in COMPONENTS if c != "contraction"}
    for left in COMPONENTS:
        rest = {c: w for c, w in WEIGHTS.items() if c != left}
        out[f"without_{left}"] = _wsum({c: w / sum(rest.values()) for c, w in rest.items()})
    return out


def _lags() -> str:
    out = []
    for h in (3, 7, 14):
        w = f"(ORDER BY n ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        label = f"CASE WHEN count(equal_weight) OVER {w} >= {h} THEN CAST(sum(equal_weight) OVER {w} <= ln(0.95) AS INTEGER) END"
        for lag in (0, 1, 3, 7):
            cols = ", ".join(f"lag({c}, {lag}) OVER (ORDER BY n) AS {c}" for c in _ALL)
            some = " AND ".join(f"{c} IS NOT NULL" for c in (*_ALL, "label"))
            out.append(f"SELECT *, CASE WHEN period >= holdout_start THEN 'test' WHEN period < holdout_start - {h} THEN 'train' ELSE 'purge' END AS role FROM (SELECT {h} AS horizon, {lag} AS lag, period, {cols}, {label} AS label FROM frame), (SELECT max(holdout_start) AS holdout_start FROM split) WHERE {some}")
    return " UNION ALL ".join(out)


_MOM = "ORDER BY n ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING"

#: Named subqueries; each may use the others.
CTE = {
    "p1": "SELECT CAST(l_linenumber AS INTEGER) AS entity, CAST(l_linenumber % 3 AS INTEGER) AS category, CAST(l_shipdate AS DATE) AS period, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL",
    "p2": "SELECT CAST(user_id % 8 AS INTEGER) AS entity, CAST(user_id % 8 % 3 AS INTEGER) AS category, date_trunc('hour', ts) AS period, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "r1": "SELECT CAST(user_id % 8 AS INTEGER) AS entity, event_type AS category, CAST(ts AS DATE) AS period, ts AS observed_at, value FROM events",
    "s1": "SELECT CAST(o_orderdate AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL",
    "f1": "SELECT CAST(l_shipdate AS DATE) AS period, round(sum(l_quantity), 2) AS level FROM lineitem GROUP BY ALL",
    "factor": "SELECT *, ln(level) - ln(lag(level) OVER (ORDER BY period)) AS factor_return FROM f1",
    "ret": _RET.format(unit="day", panel="p1"),
    "ret2": _RET.format(unit="hour", panel="p2"),
    "flows": "SELECT period, value, CASE WHEN date_diff('day', lag(period) OVER w, period) = 1 AND lag(value) OVER w > 0 AND value > 0 THEN ln(value / lag(value) OVER w) END AS log_flow FROM s1 WINDOW w AS (ORDER BY period)",
    "sysd": "SELECT d.*, f.value AS series_value, f.log_flow AS series_flow FROM (SELECT period, sum(value) AS total_value, avg(log_return) AS equal_weight_return, avg(CASE WHEN log_return < 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS downside_breadth, count(log_return) AS n_active, min(drawdown) AS worst_drawdown FROM ret WHERE log_return IS NOT NULL GROUP BY period) d LEFT JOIN flows f USING (period) WHERE n_active >= 6",
    "idx": "SELECT period, row_number() OVER (ORDER BY period) AS n FROM (SELECT DISTINCT period FROM p1)",
    "wide": "SELECT period, n, entity, category, value, log_return FROM idx CROSS JOIN (SELECT DISTINCT entity FROM p1) LEFT JOIN ret USING (period, entity)",
    "cells": "SELECT entity, category, period, n, value, CASE WHEN log_return IS NOT NULL THEN least(greatest(log_return, -0.35), 0.35) END AS ret, lag(value) OVER (PARTITION BY entity ORDER BY n) AS lagged FROM wide",
    "members": "SELECT *, coalesce(first_return <= start AND share >= 0.95, false) AS member FROM (SELECT entity, min(period) FILTER (log_return IS NOT NULL) AS first_return, max(start) AS start, avg(CASE WHEN log_return IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (period >= start) AS share FROM wide, (SELECT min(period) AS start FROM sysd) GROUP BY entity)",
    "b_eq": "SELECT period, n, CASE WHEN count(ret) >= 6 THEN avg(ret) END AS equal_weight FROM cells GROUP BY ALL",
    "b_lag": "SELECT period, n, CASE WHEN count(ret) >= 6 THEN sum(lagged * ret) / nullif(sum(lagged) FILTER (ret IS NOT NULL), 0) END AS lagged_weight FROM cells GROUP BY ALL",
    "capw": """SELECT *, CASE WHEN x IS NULL THEN NULL WHEN stop IS NULL OR k < stop THEN 0.25::DOUBLE ELSE x * max(CASE WHEN k = stop THEN scale END) OVER (PARTITION BY period) END AS capped FROM
      (SELECT *, min(CASE WHEN x * scale <= 0.25::DOUBLE + 1e-12 THEN k END) OVER (PARTITION BY period) AS stop FROM
      (SELECT *, CASE WHEN x IS NOT NULL THEN (1 - k * 0.25::DOUBLE) / rest END AS scale FROM
      (SELECT *, row_number() OVER o - 1 AS k, sum(x) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM
      (SELECT *, CASE WHEN lagged > 0 AND ret IS NOT NULL THEN lagged END AS x FROM cells) WINDOW o AS (PARTITION BY period ORDER BY x DESC NULLS LAST, entity))))""",
    "b_cap": "SELECT period, n, CASE WHEN count(ret) >= 6 THEN sum(capped * ret) / nullif(sum(capped) FILTER (ret IS NOT NULL), 0) END AS capped_weight FROM capw GROUP BY ALL",
    "b_cat": "SELECT period, n, CASE WHEN sum(k) >= 6 THEN avg(m) END AS category_weight FROM (SELECT period, n, category, avg(ret) AS m, count(ret) AS k FROM cells GROUP BY ALL) GROUP BY ALL",
    "b_com": "SELECT period, n, CASE WHEN size > 0 AND k = size THEN m END AS common_history FROM (SELECT DISTINCT period, n FROM cells) LEFT JOIN (SELECT period, avg(ret) AS m, count(ret) AS k FROM cells SEMI JOIN (SELECT entity FROM members WHERE member) USING (entity) GROUP BY period) USING (period), (SELECT count(*) FILTER (member) AS size FROM members)",
    "baskets": "SELECT * FROM b_eq JOIN b_lag USING (period, n) JOIN b_cap USING (period, n) JOIN b_cat USING (period, n) JOIN b_com USING (period, n)",
    "net": _net("ret", "cells"),
    "net2": _net("log_return", "(SELECT row_number() OVER (ORDER BY period) AS n, period FROM (SELECT DISTINCT period FROM p2)) JOIN ret2 USING (period)"),
    "resid": f"""SELECT *, ret - (alpha + beta * factor_return) AS residual FROM (SELECT *, my - beta * mx AS alpha FROM (SELECT *, cv / nullif(vr, 0) AS beta FROM
      (SELECT c.*, factor_return, CASE WHEN count(CASE WHEN ret IS NOT NULL THEN factor_return END) OVER w >= 90 THEN covar_samp(ret, factor_return) OVER w END AS cv, CASE WHEN count(factor_return) OVER w >= 90 THEN var_samp(factor_return) OVER w END AS vr,
       CASE WHEN count(factor_return) OVER w >= 90 THEN avg(factor_return) OVER w END AS mx, CASE WHEN count(ret) OVER w >= 90 THEN avg(ret) OVER w END AS my FROM cells c LEFT JOIN factor USING (period) WINDOW w AS (PARTITION BY entity {_MOM}))))""",
    "rnet": _net("residual", "resid", "residual_"),
    "edges": f"""SELECT src, dst, rho FROM (SELECT a.entity AS src, b.entity AS dst, CASE WHEN count(*) FILTER (a.ret IS NOT NULL AND b.ret IS NOT NULL) >= {NEEDED} THEN covar_samp(a.ret, b.ret) / nullif(stddev_samp(a.ret) FILTER (b.ret IS NOT NULL) * stddev_samp(b.ret) FILTER (a.ret IS NOT NULL), 0) END AS rho
      FROM cells a JOIN cells b ON a.n = b.n AND a.entity <> b.entity WHERE a.n > (SELECT max(n) FROM cells) - {WINDOW} GROUP BY ALL) WHERE rho >= {THRESHOLD}""",
    "br": "SELECT period, count(*) FILTER (ret < 0) / nullif(count(ret), 0)::DOUBLE AS breadth FROM cells GROUP BY period",
    "frame": f"""SELECT *, CASE WHEN forward_return IS NOT NULL THEN CAST(forward_return <= ln(0.95) AS INTEGER) END AS label FROM (SELECT *, -({_rolling("sum", "flow", 7)}) AS contraction, {_rolling("stddev_samp", "equal_weight", 30)} AS volatility, -({_rolling("sum", "equal_weight", 7)}) AS momentum,
      CASE WHEN count(equal_weight) OVER f >= 7 THEN sum(equal_weight) OVER f END AS forward_return FROM (SELECT period, n, mean_correlation AS correlation, density, equal_weight, log_flow AS flow, breadth FROM net LEFT JOIN (SELECT period, equal_weight FROM b_eq) USING (period) LEFT JOIN (SELECT period, log_flow FROM flows) USING (period) LEFT JOIN br USING (period)) WINDOW f AS (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))""",
    "valid": "SELECT * FROM frame WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in (*_ALL, "label")),
    "split": _roles("(SELECT *, max(CASE WHEN i = least(greatest(CAST(floor(k * 0.7::DOUBLE) AS INTEGER), 1), k - 1) THEN period END) OVER () AS holdout_start FROM (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS k FROM valid))"),
    "limits": f"SELECT {_limits(_ALL)} FROM split WHERE role = 'train'",
    "scaled": f"SELECT period, role, label, {', '.join(_z(c) for c in _ALL)} FROM split, limits",
    "scores": long_sql("(SELECT * FROM scaled WHERE role <> 'purge')", SIMPLE, "period, role, label"),
    "thresholds": threshold_sql("scores", "model"),
    "comps": long_sql("split", {c: c for c in COMPONENTS}, "period, role, label", "component", "x"),
    "alerts": "SELECT s.period, s.label, s.score, CAST(s.score >= t.threshold AS INTEGER) AS alert FROM scores s JOIN thresholds t USING (model) WHERE model = 'heuristic' AND role = 'test'",
    "stress": "SELECT *, sum(new) OVER (ORDER BY period) AS episode FROM (SELECT *, CASE WHEN label = 1 AND lag(label, 1, 0) OVER (ORDER BY period) = 0 THEN 1 ELSE 0 END AS new FROM alerts)",
    "onsets": "SELECT episode::BIGINT AS episode, min(period) AS onset, max(period) AS \"end\", count(*) AS duration, max(alert) AS alert_from_onset FROM stress WHERE label = 1 GROUP BY episode",
    "lagged": _lags(),
    "laglim": f"SELECT horizon, lag, {_limits(COMPONENTS)} FROM lagged WHERE role = 'train' GROUP BY horizon, lag",
    "lagz": f"SELECT horizon, lag, period, label, {', '.join(_z(c) for c in COMPONENTS)} FROM lagged JOIN laglim USING (horizon, lag) WHERE role = 'test'",
    "lagscores": long_sql("lagz", {"heuristic": HEURISTIC} | {c: f"z_{c}" for c in COMPONENTS}, "horizon, lag, period, label"),
    "ablscores": long_sql("(SELECT * FROM scaled WHERE role <> 'purge')", _ablation(), "period, role, label", "specification"),
    "wins": "SELECT model, period, label, score, CAST(w AS INTEGER) AS w FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY period) AS r, count(*) OVER (PARTITION BY model) AS n FROM scores), range(0, 100) t(w) WHERE 180 + 30 * w <= n AND r > 30 * w AND r <= 180 + 30 * w",
    "bl": f"SELECT period, 1 - exp({_rolling('sum', 'r', 7)}) AS loss FROM (SELECT period, n, avg(ret) AS r FROM cells GROUP BY ALL)",
    "losses": f"SELECT entity, period, n, 1 - exp({_rolling('sum', 'ret', 7, 'PARTITION BY entity')}) AS loss FROM cells",
}
CTE["net2"] = _net("log_return", "cells2").replace(f">= {NEEDED}", ">= 20")
CTE["cells2"] = "SELECT * FROM (SELECT row_number() OVER (ORDER BY period) AS n, period FROM (SELECT DISTINCT period FROM p2)) CROSS JOIN (SELECT DISTINCT entity FROM p2) LEFT JOIN ret2 USING (period, entity)"


def build(select: str, doubles: tuple[str, ...] = ()) -> str:
    """The statement with the subqueries that it needs, and doubles rounded as the queries round them."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b{name}\b(?!\.)", text) and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                need(CTE[name])
                if name not in order:
                    order.append(name)

    need(select)
    head = "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in order) if order else ""
    if doubles:
        select = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in doubles)}) FROM ({select})"
    return f"{head} {select}"
