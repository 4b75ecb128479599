"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each document gets a few plain counts. A fixed base rule rejects documents that are too short or
mostly repeat themselves. Beyond it, one-sided rules ("reject if a metric is above its cutoff") work together: a
ladder of STEPS steps, fixed before labels are seen, gives all rules a cutoff at each step, from lax to strict.
Cutoffs are chosen stratum by stratum from labelled documents: a step is certified if an exact binomial test rejects
"the step's rules together reject more than alpha of the good documents", and the strictest step before the first
that is not certified counts. Fixed-sequence testing needs no correction within a ladder; strata share delta by
Bonferroni. So with probability 1 - delta the rules together reject, in no stratum, more than alpha of good documents.

With n good labels in one of s strata, none of them rejected, a step is certified from n = log(delta / s) / log(1 - alpha) on:
217 for the defaults and four strata. A stratum with fewer certifies nothing.

Defined cases: a null text counts as empty (no words, base rule fails); a text of any length is measured whole; a null
stratum is a stratum of its own; a stratum without enough labels keeps all that the base rule keeps; a metric equal
to its cutoff does not reject; repeated rows each get their row; labels with a null id or quality are ignored, an id labelled
more than once is good only if all its labels are; an empty table gives an empty one; other columns of the input are left
alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, materialise, small_join

NO_STRATUM = "(none)"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Reject above a cutoff; the grid runs from lax to strict and is fixed before labels are seen."""

    name: str
    grid: tuple[float, ...]


RULES = (
    Rule("symbols_per_word", (2.0, 1.5, 1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25)),
    Rule("upper_share", (0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3)),
    Rule("dup_line_share", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5)),
    Rule("repeat_word_share", (0.29, 0.28, 0.27, 0.26, 0.25, 0.24, 0.23, 0.22, 0.21, 0.2)),
    Rule("mean_word_chars", (60.0, 50.0, 40.0, 35.0, 30.0, 25.0, 20.0, 17.0, 14.0, 12.0)),
)
STEPS = 10
ALPHA = 0.02
DELTA = 0.05
WINDOW = 8


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of this width at sorted starts."""
    first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(
        starts,
        first,
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(width), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS, the rules' metrics and base_failed as columns prefixed `q_`."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("q_words", F.array_remove(F.split(t, SPACE), ""))
    n = F.size("q_words")
    out = out.withColumns(
        {
            "q_n_words": n,
            "q_word_chars": F.length(F.array_join("q_words", "")),
            "q_n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
            "q_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "q_windows": F.when(
                n >= WINDOW,
                F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("q_words", i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("q_words")
    twice = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    ranked = F.array_sort(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("q_ranked", F.when(twice, ranked)).drop("q_windows")
    alike = F.filter(
        "q_ranked",
        lambda x, i: F.coalesce(x["h"] == F.get("q_ranked", i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("q_ranked", i + 1)["h"], F.lit(False)),
    )
    out = out.withColumns(
        {
            "q_n_repeat_words": F.coalesce(_covered(F.array_sort(F.transform(alike, lambda x: x["i"])), WINDOW), F.lit(0)),
            "q_n_lines": F.size("q_lines"),
            "q_n_dup_lines": F.size("q_lines") - F.size(F.array_distinct("q_lines")),
        }
    ).drop("q_ranked", "q_lines")

    def per(x: str, y: str) -> Column:
        return F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))

    return out.withColumns(
        {f"q_{c}": F.col(f"q_{c}").cast("long") for c in COUNTS}
        | {
            "q_base_failed": (F.col("q_n_words") < 20) | (F.lit(100) * F.col("q_n_repeat_words") > F.lit(30) * F.col("q_n_words")),
            "q_symbols_per_word": per("q_n_symbols", "q_n_words"),
            "q_upper_share": per("q_upper", "q_word_chars"),
            "q_dup_line_share": per("q_n_dup_lines", "q_n_lines"),
            "q_repeat_word_share": per("q_n_repeat_words", "q_n_words"),
            "q_mean_word_chars": per("q_word_chars", "q_n_words"),
        }
    ).drop("q_upper", "q_n_lines")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact: the terms follow each other in logarithms."""
    from math import log

    start = n * F.lit(log(1 - p))
    first = F.struct(start.alias("t"), F.exp(start).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), first, add, lambda a: a["s"])
    return F.when(k >= n, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(some)


def _above(rules: tuple[Rule, ...], step: int) -> Column:
    """Whether any metric is above its cutoff at this step of the ladder."""
    out = F.lit(False)
    for r in rules:
        out = out | (F.col(f"q_{r.name}") > r.grid[step])
    return out


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(q_stratum, q_step): the strictest certified step of each stratum that certifies one."""
    good = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(id_col)
        .agg(F.min("quality").alias("q_quality"))
        .where("q_quality = 1")
    )
    metrics = [f"q_{r.name}" for r in rules]
    seen = measured.select(F.col(id_col), F.coalesce(F.col(stratum), F.lit(NO_STRATUM)).alias("q_stratum"), *metrics).join(good.select(id_col), id_col, "left_semi")
    # One wide row for each stratum, combined before the shuffle; then long, one row for each step.
    wide = seen.groupBy("q_stratum").agg(F.count(F.lit(1)).alias("q_n"), *[F.count_if(_above(rules, i)).alias(f"q_{i}") for i in range(STEPS)])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"q_{i}").alias("k")) for i in range(STEPS)])
    each = wide.select("q_stratum", "q_n", F.explode(steps).alias("x")).select("q_stratum", "q_n", "x.*")
    share = wide.agg(F.count(F.lit(1)).alias("q_strata"))  # one row
    # From n x alpha on the tail is about a half or more: nothing to add up, so a sum has at most n x alpha terms.
    tail = F.when(F.col("k") < F.col("q_n") * alpha, binomial_tail(F.col("q_n"), F.col("k"), alpha)).otherwise(F.lit(1.0))
    tested = each.crossJoin(F.broadcast(share)).withColumn("passed", tail <= F.lit(delta) / F.col("q_strata"))
    stop = tested.groupBy("q_stratum").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.lit(STEPS)).alias("stop"))
    return stop.where("stop > 0").select("q_stratum", (F.col("stop") - 1).alias("q_step"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with q_kept: neither the base rule nor a certified step rejects the document."""
    keyed = measured.withColumn("q_stratum", F.coalesce(F.col(stratum), F.lit(NO_STRATUM)))
    out = small_join(keyed, cutoffs, "q_stratum")
    bad = F.col("q_base_failed")
    for r in rules:
        cutoff = F.get(F.array(*[F.lit(c) for c in r.grid]), F.col("q_step"))
        bad = bad | F.coalesce(F.col(f"q_{r.name}") > cutoff, F.lit(False))
    return out.withColumn("q_kept", ~bad).drop("q_stratum", "q_step")


def quality_gate(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", id_col: str = "doc_id", keep: list[str] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The columns of docs in keep (all by default), named k_<name>, and the q_ columns.

    Counts are taken once and written; with the text among them it is written too, so that it is never shuffled.
    """
    keep = list(docs.columns if keep is None else keep)
    need = list(dict.fromkeys([*keep, id_col, stratum, text]))
    measured = measure(docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in need]), f"k_{text}")
    if text not in keep:
        measured = measured.drop(f"k_{text}")
    measured = materialise(measured, "quality")
    known = labels.withColumnRenamed(id_col, f"k_{id_col}")
    cutoffs = materialise(calibrate(measured, known, f"k_{stratum}", f"k_{id_col}", alpha=alpha, delta=delta), "cutoffs")
    return judge(measured, cutoffs, f"k_{stratum}")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that neither the base rule nor a certified cutoff rejects."""
    out = quality_gate(docs, labels, **how).where("q_kept")
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_gate(documents(spark, sf_dir), labels, keep=["doc_id", "lang"])
    return out.select(F.col("k_doc_id").alias("doc_id"), *[F.col(f"q_{c}").alias(c) for c in COUNTS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def _oracle() -> str:
    ladder = ", ".join(f"({i}, {', '.join(f'{r.grid[i]!r}::DOUBLE' for r in RULES)})" for i in range(STEPS))
    above = " OR ".join(f"{r.name} > cut_{r.name}" for r in RULES)
    return rf"""
WITH ladder AS (SELECT * FROM (VALUES {ladder}) AS v(step, {", ".join("cut_" + r.name for r in RULES)})),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '{NO_STRATUM}') AS stratum, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + {WINDOW - 1}]) AS c FROM p),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, {WINDOW}) AS t(k) WHERE c > 1 GROUP BY rid),
b AS (SELECT w.rid, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS up,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(up::DOUBLE / nullif(word_chars, 0), 0) AS upper_share,
  coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_word_share,
  coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars FROM b),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
t AS (SELECT stratum, step, count(*) AS n, count(*) FILTER ({above}) AS k FROM m SEMI JOIN good USING (doc_id), ladder GROUP BY ALL),
q AS (SELECT *, CASE WHEN k >= n * {ALPHA!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA!r}) + (n - i) * ln(1 - {ALPHA!r})))) END <= {DELTA!r}::DOUBLE / (SELECT count(DISTINCT stratum) FROM t) AS passed FROM t),
z AS (SELECT stratum, coalesce(min(step) FILTER (NOT passed), {STEPS}) - 1 AS step FROM q GROUP BY stratum),
bad AS (SELECT rid FROM m JOIN z USING (stratum) JOIN ladder USING (step) WHERE {above})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND bad.rid IS NULL) AS kept FROM m LEFT JOIN bad USING (rid)
"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": _oracle()}
