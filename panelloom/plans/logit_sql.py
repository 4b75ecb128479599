"""Regularised logistic models in SQL: Newton steps in a recursive subquery, until they are far below what rounding to six digits shows.

How rare the label is does not matter: the intercept, which has no penalty, curves as its share does, and a Newton step takes account
of that. A step d is shortened to log(1 + a) / a of its length, a being the longest row times the length of d, with which the loss falls
from anywhere. Labels of one class have no finite optimum: coefficients are zero there, and the intercept is the bound.
"""

from __future__ import annotations

from ..operators.features import COMPONENTS
from ..operators.models import BOUND, L2, candidates
from .oracle import rank_sql

STEPS, TOL = 1000, 1e-9
K = len(COMPONENTS)
X = f"[{', '.join(COMPONENTS)}]"


def mask(features: tuple[str, ...]) -> str:
    return "[" + ", ".join("1.0::DOUBLE" if c in features else "0.0::DOUBLE" for c in COMPONENTS) + "]"


def _line(b: str, z: str) -> str:
    return f"least(greatest({b}[1] + " + " + ".join(f"{b}[{k + 2}] * {z}[{k + 1}]" for k in range(K)) + f", {-BOUND!r}::DOUBLE), {BOUND!r}::DOUBLE)"


def fits(rows: str) -> str:
    """(fit, mask, b, m, s) from rows (fit, mask, label, x): coefficients b on features standardised by m and s."""
    each = lambda f: "[" + ", ".join(f(k + 1) for k in range(K)) + "]"
    z, penalty = ["1.0::DOUBLE", *[f"z[{k + 1}]" for k in range(K)]], [0.0, *[L2] * K]
    # The second derivatives beside the gradient: elimination on rows leaves the step in the last column.
    row = lambda i: "[" + ", ".join([*[f"avg(w * {z[i]} * {z[j]}) + {penalty[i] * (i == j)!r}::DOUBLE" for j in range(K + 1)], f"avg(e * {z[i]}) + {penalty[i]!r}::DOUBLE * any_value(b)[{i + 1}]"]) + "]"
    solved = f"list_reduce({list(range(1, K + 2))}, lambda a, k: list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(a[k], lambda v: v / a[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * a[k][j] / a[k][k]) END), a)"
    length = "sqrt(list_sum(list_transform(d, lambda v: v * v)))"
    none = ", ".join(["0.0::DOUBLE"] * K)
    return f"""(WITH RECURSIVE q AS MATERIALIZED (SELECT fit, mask, label, x FROM {rows}),
      st AS MATERIALIZED (SELECT fit, any_value(mask) AS mask, avg(label::DOUBLE) AS share, {each(lambda k: f"avg(x[{k}])")} AS m, {each(lambda k: f"coalesce(nullif(stddev_pop(x[{k}]), 0), 1)")} AS s FROM q GROUP BY fit),
      zs AS MATERIALIZED (SELECT fit, label, {each(lambda k: f"(x[{k}] - m[{k}]) / s[{k}] * st.mask[{k}]")} AS z FROM q JOIN st USING (fit)),
      far AS MATERIALIZED (SELECT fit, sqrt(max(1 + {" + ".join(f"z[{k + 1}] ** 2" for k in range(K))})) AS far FROM zs GROUP BY fit),
      gd AS (SELECT fit, 0 AS step, far, [CASE WHEN share IN (0, 1) THEN {BOUND!r}::DOUBLE * (2 * share - 1) ELSE ln(share / (1 - share)) END, {none}] AS b, share NOT IN (0, 1) AS moves FROM st JOIN far USING (fit) UNION ALL
        SELECT fit, step + 1, far, list_transform(b, lambda v, i: v - scale * d[i]), list_max(list_transform(d, lambda v: abs(v))) > {TOL!r}::DOUBLE FROM (SELECT *, CASE WHEN reach > 0 THEN ln(1 + reach) / reach ELSE 1 END AS scale FROM (SELECT *, far * {length} AS reach FROM (SELECT fit, step, far, b, list_transform({solved}, lambda r: r[{K + 2}]) AS d FROM
          (SELECT fit, any_value(step) AS step, any_value(far) AS far, any_value(b) AS b, [{", ".join(row(i) for i in range(K + 1))}] AS a FROM (SELECT *, p - label AS e, p * (1 - p) AS w FROM (SELECT gd.fit, step, far, b, z, label, 1 / (1 + exp(-{_line("b", "z")})) AS p FROM gd JOIN zs USING (fit) WHERE moves AND step < {STEPS})) GROUP BY fit)))))
      SELECT fit, mask, b, m, s FROM (SELECT fit, arg_max(b, step) AS b FROM gd GROUP BY fit) JOIN st USING (fit))"""


def probability(x: str = "x") -> str:
    """The score by a fit whose columns are at hand."""
    z = "[" + ", ".join(f"({x}[{k + 1}] - m[{k + 1}]) / s[{k + 1}] * mask[{k + 1}]" for k in range(K)) + "]"
    return f"1 / (1 + exp(-{_line('b', z)}))"


def terms(fitted: str, keep: str = "fit") -> str:
    """A row for each model and term."""
    names = ["intercept", *COMPONENTS]
    return f"(SELECT {keep}, unnest({names!r}) AS component, unnest(b) AS coefficient FROM {fitted})"


_PARTS = ", ".join(f"({k}, {k / 3!r}::DOUBLE, {(k + 1) / 3!r}::DOUBLE)" for k in range(3))
_CANDIDATES = ", ".join(f"('{'+'.join(c)}', {len(c)}, {mask(c)})" for c in candidates())


def selection(train: str) -> str:
    """(task, features, n_features, mean_average_precision, folds, selected, mask) from training rows (task, period, label, components)."""
    kinds = lambda c: f"(count(*) FILTER ({c} AND label = 1) OVER w > 0 AND count(*) FILTER ({c} AND label = 0) OVER w > 0)"
    return f"""(WITH t1 AS (SELECT task, period, label, {X} AS x, row_number() OVER (PARTITION BY task ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY task) AS size FROM {train}),
      t2 AS (SELECT *, i >= floor(start + (size - start) * lo) AND i < floor(start + (size - start) * hi) AS tested FROM (SELECT *, greatest(240, floor(size * 0.5::DOUBLE)) AS start FROM t1), (VALUES {_PARTS}) AS v(fold, lo, hi)),
      t3 AS (SELECT *, period < min(period) FILTER (tested) OVER (PARTITION BY task, fold) - 7 AS learns FROM t2),
      t4 AS MATERIALIZED (SELECT * FROM (SELECT *, {kinds("tested")} AND {kinds("learns AND NOT tested")} AND count(*) FILTER (learns AND NOT tested) OVER w >= 150 AS fair FROM t3 WHERE tested OR learns WINDOW w AS (PARTITION BY task, fold)) WHERE fair),
      own AS MATERIALIZED (SELECT *, task || '|' || fold || '|' || features AS fit FROM t4, (VALUES {_CANDIDATES}) AS v(features, n_features, mask)),
      fitted AS MATERIALIZED (SELECT * FROM {fits("(SELECT * FROM own WHERE learns AND NOT tested)")}),
      found AS (SELECT task, features, n_features, avg(average_precision) AS mean_average_precision, count(average_precision)::INTEGER AS folds, any_value(mask) AS mask FROM ({rank_sql(f"(SELECT task, features, n_features, mask, fold, label, {probability()} AS score FROM (SELECT * EXCLUDE (mask) FROM own) JOIN fitted USING (fit) WHERE tested)", "task, features, n_features, mask, fold")}) GROUP BY ALL)
      SELECT * EXCLUDE (r), r = 1 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY mean_average_precision < best - 0.005::DOUBLE, n_features, mean_average_precision DESC, features) AS r FROM (SELECT *, max(mean_average_precision) OVER (PARTITION BY task) AS best FROM found)))"""


def all_scores(frame: str, simple: str) -> str:
    """(task, period, role, label, model, score) of both logistic models and of the simple ones: frame (task, role, period, label,
    components), simple: a table (task, period, role, label, model, score)."""
    picked = selection(f"(SELECT * FROM {frame} WHERE role = 'train')")
    rows = f"(SELECT task, period, role, label, {X} AS x, model, mask, task || '|' || model AS fit FROM {frame} JOIN (SELECT DISTINCT task, 'logistic_all' AS model, {mask(COMPONENTS)} AS mask FROM {frame} UNION ALL SELECT task, 'logistic_selected', mask FROM {picked} WHERE selected) USING (task) WHERE role <> 'purge')"
    return f"""(WITH lg AS MATERIALIZED (SELECT * FROM {rows}), lf AS MATERIALIZED (SELECT * FROM {fits("(SELECT * FROM lg WHERE role = 'train')")})
      SELECT task, period, role, label, model, score FROM {simple} UNION ALL SELECT task, period, role, label, model, {probability()} AS score FROM (SELECT * EXCLUDE (mask) FROM lg) JOIN lf USING (fit))"""
