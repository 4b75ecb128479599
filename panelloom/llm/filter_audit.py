"""Audit of filters that act one after the other: what each removes, alone and after others, in every order.

Each document gets five failure flags. Documents are counted by part (their source), flags and labels, which
leaves at most 32 x 4 rows a part. A SQL CUBE over the flags and the part then gives, for every subset of filters, its
survivors: the grouping-set row whose selected flags are all false. A step of an order goes from the survivors of
the filters before it to those of these and its own, so each step is a join of two subsets' rows.

Copies: a text's first id is found by an aggregate over digests of the texts (combined before the shuffle), and joined to
all rows by digest; a group of copies of any size may be split there, as nothing gathers it.

Defined cases: a null text counts as empty (fails A, not B to D); a null part is the part of the empty string; a null id comes
after all others in E, so that it fails where any other id has its text; rows that repeat the smallest id of their text don't
fail E; an id is good, or toxic, if any row of the labels says so; labels with a null id count for nothing; texts of any
length are measured whole; an empty table gives no rows; only the named columns are read, whatever others there are.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, materialise, text_of

FILTERS = "ABCDE"
N = len(FILTERS)
#: Orders in which one filter comes after a given set of k others: k! (N - 1 - k)!
_WEIGHT = [factorial(k) * factorial(N - 1 - k) for k in range(N)]


def own_flags(docs: DataFrame, part: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, part, digest, A to D): the conditions that a document's own text decides."""
    t = F.col("t")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(part).alias("part"), text_of(text).alias("t")).withColumn("words", F.array_remove(F.split(t, SPACE), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return d.select(
        "id", "part", F.unhex(F.sha2(t, 256)).alias("digest"), (n < 50).alias("A"), (F.lit(100) * distinct < F.lit(65) * n).alias("B"),
        (F.lit(100) * F.regexp_count(t, F.lit("[A-Z]")) > F.lit(5) * F.length(t)).alias("C"), t.rlike("[#$%&*|]").alias("D"),
    )


def flagged(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, A to E, good, toxic): a row for each document."""
    own = materialise(own_flags(docs, part, text, id_col), "flags")  # texts are read once
    copied = own.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    copied = materialise(copied.select("digest", "first"), "copied")  # a table of its own, as the join of an aggregate is not split where it is skewed
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    marked = own.join(copied, "digest", "left").select("id", "part", *"ABCD", later.alias("E"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    said = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).where("good OR toxic")
    return marked.join(said, "id", "left").select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of the part that no filter of the mask rejects; bit k is filter k.

    All 32 masks of each part are there, with zeros where nothing survives; the null part is the whole table.
    """
    counts = flags.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    chosen = sum((F.shiftleft(F.lit(1) - F.grouping(f).cast("int"), k) for k, f in enumerate(FILTERS)), F.lit(0))
    cube = counts.cube(*FILTERS, "part").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], chosen.alias("mask"))
    passing = cube.where(" AND ".join(f"NOT coalesce({f}, false)" for f in FILTERS)).select("part", "mask", "n", "good", "toxic")
    every = passing.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(2**N - 1))).alias("mask"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good", "toxic")]
    return every.alias("e").join(passing.alias("p"), F.col("e.part").eqNullSafe(F.col("p.part")) & (F.col("e.mask") == F.col("p.mask")), "left").select("e.part", "e.mask", *zero)


def _orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, before, after): 600 rows, the masks before and after each step."""
    rows = []
    for p in permutations(range(N)):
        mask = 0
        for step, k in enumerate(p, 1):
            rows.append(("".join(FILTERS[i] for i in p), step, k, mask, mask | 1 << k))
            mask |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def audit(flags: DataFrame) -> DataFrame:
    """A row for each part, order and step, from a table (part, A to E, good, toxic) of documents."""
    s = materialise(survivors(flags).where("part IS NOT NULL"), "survivors")
    per = lambda side: s.select("part", F.col("mask").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "good", "toxic")])
    # Facts of each filter in each part, from seven of its subsets: all failures, failures of it alone, and its Shapley sum.
    at = F.map_from_entries(F.collect_list(F.struct("mask", "n")))  # 32 entries
    each = s.groupBy("part").agg(at.alias("m")).select("part", "m", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("filter"))
    n = lambda mask: F.element_at("m", mask)
    bit, whole = F.expr("shiftleft(1, filter)"), F.lit(2**N - 1)
    gain = lambda m: n(m) - n(m.bitwiseOR(bit))
    without = F.filter(F.sequence(F.lit(0), whole), lambda m: m.bitwiseAND(bit) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda a, m: a + gain(m) * F.element_at(F.array(*[F.lit(w) for w in _WEIGHT]), F.bit_count(m) + 1))
    each = each.select("part", "filter", gain(F.lit(0)).alias("failing"), gain(whole.bitwiseXOR(bit)).alias("unique_fails"), shapley.alias("shapley"))
    steps = F.broadcast(_orders(flags.sparkSession))  # 600 rows
    out = per("before").join(steps, "before").join(per("after"), ["part", "after"]).join(each, ["part", "filter"])
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    return out.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), lost("n").alias("removed"), (F.col("failing") - lost("n")).alias("redundant"), "unique_fails",
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), "shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: Order by order and document by document, without subsets.
_ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words FROM t),
f AS (SELECT rid, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
o AS (SELECT [a, b, c, d, e] AS ord, chr((64 + a)::INTEGER) || chr((64 + b)::INTEGER) || chr((64 + c)::INTEGER) || chr((64 + d)::INTEGER) || chr((64 + e)::INTEGER) AS filter_order
  FROM range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
x AS (SELECT rid, part, fails, good, toxic, filter_order, ord, list_position(list_transform(ord, lambda k: fails[k]), true) AS gone FROM f, o),
y AS (SELECT *, unnest(range(1, 6)) AS step FROM x),
z AS (SELECT part, filter_order, step::INTEGER AS step, any_value(ord[step]) AS own, count(*) FILTER (gone IS NULL OR gone > step) AS kept, count(*) FILTER (gone = step) AS removed, count(*) FILTER (gone < step AND fails[ord[step]]) AS redundant,
  count(*) FILTER (fails[ord[step]] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails, count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": _ORACLE}
