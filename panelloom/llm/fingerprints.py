"""Document fingerprints by SimHash, and the search for all fingerprints within a Hamming radius.

Terms are runs of three words and of four characters; each distinct term votes on 128 signed bits with the weight
1 + ln(its count). That of characters is multiplied by 1 in a text of one word, and by evenly less for each further word, down to
0 at FADE words; so texts of n and n + 1 words have terms of nearly the same weights, and no length parts
neighbours. For the search, the bits are dealt to radius + 2 blocks
by a permutation; two fingerprints within the radius agree on at least two blocks, so there is one table
for each pair of blocks, keyed by the two blocks' bits. No pair within the radius is missed, and each is
found once, in the first table where it agrees. The index holds distinct fingerprints with their numbers of documents;
what leaves it for a query is a pair of fingerprints, counted, with the nearest one's smallest id.

The query also gives each text an edited version whose end comes from the next document in descending
order of ids. Documents are dealt out by ranges of ids; a worker pairs neighbours of its range as they
stream by, and only the first and last document of each range are joined afterwards.

Defined cases: a null or empty text has fingerprint zero; texts alike have fingerprints alike; a null id
comes last; rows that repeat an id are ordered by their text; a single document follows itself; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise
from .covering_lsh import signed

BITS = 128
SHINGLE = 3
FADE = 64  # words; from there on runs of characters have no weight left
RADIUS = 3
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _runs(x: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of the runs of n numbers."""
    if len(x) < n:
        return x[:0]
    h = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        h = _mix(h + x[k : len(x) - n + 1 + k] + _U(salt))
    return h


class SimHash:
    """Fingerprints of texts; keeps the hashes of frequent words up to a bound."""

    def __init__(self, keep: int = 500_000):
        from .ngram_lm import Words

        self.words = Words(keep)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of distinct terms and their weights."""
        w = self.words.of(text.encode("utf-8", "replace"))
        if not len(w):
            return w, np.zeros(0, np.float32)
        kinds = [(_runs(w, max(1, min(SHINGLE, len(w))), 0), 1.0)]
        faded = 1 - (len(w) - 1) / FADE
        if faded > 0:
            points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            kinds.append((_runs(points, 4, 1 << 40), faded))
        found = [(*np.unique(h, return_counts=True), f) for h, f in kinds]
        return np.concatenate([h for h, _, _ in found]), np.concatenate([f * (1 + np.log(n)) for _, n, f in found]).astype(np.float32)

    def of(self, text: str, chunk: int = 1 << 15) -> np.ndarray:
        """The bits, packed into 16 bytes."""
        h, weight = self.terms(text)
        votes = np.zeros(BITS)
        for i in range(0, len(h), chunk):
            part = np.stack([h[i : i + chunk], _mix(h[i : i + chunk] + _U(0x5851F42D4C957F2D))], axis=1)
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
            w = weight[i : i + chunk]
            votes += 2.0 * (w @ bits.astype(np.float32)) - float(w.sum())
        return np.packbits(votes > 0, bitorder="little")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - int(np.unpackbits(a ^ b).sum()) / BITS


def edit(text: str, following: str) -> str:
    """The last third of the text replaced by the first as many code points of what follows."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FIELDS = "n_chars long, edited_sha256 string, lo long, hi long, edited_fingerprint string, near_edited double, near_next double"


def _digest(text: str, mine: np.ndarray, following: str, next_: np.ndarray, maker: SimHash) -> tuple:
    edited = edit(text, following)
    theirs = mine if edited == text else maker.of(edited)
    lo, hi = (signed(int(x)) for x in mine.view(np.uint64))
    return len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), lo, hi, theirs.tobytes().hex(), likeness(mine, theirs), likeness(mine, next_)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ...) of _FIELDS: fingerprints of each document, its edited text and the next document."""
    from pyspark.sql.types import StructType

    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("utf8")
    dealt = docs.select(F.col(id_col).alias("id"), utf8).repartitionByRange(F.desc_nulls_last("id")).sortWithinPartitions(F.desc_nulls_last("id"), F.asc("utf8"))
    fields = StructType.fromDDL(f"part int, kind int, id {dealt.schema['id'].dataType.simpleString()}, utf8 binary, {_FIELDS}")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        part, maker, schema = TaskContext.get().partitionId(), SimHash(), to_arrow_schema(fields)
        blank = (None,) * 7
        last = None
        for b in batches:
            rows = []
            for id_, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = raw.decode("utf-8", "replace")
                mine = maker.of(t)
                if last is None:
                    rows.append((part, 2, None, raw, *blank))  # what the range before this one ends with needs it
                else:
                    rows.append((part, 0, last[0], None, *_digest(last[1], last[2], t, mine, maker)))
                last = id_, t, mine
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        if last is not None:
            row = (part, 1, last[0], last[1].encode("utf-8", "replace"), *blank)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    all_ = materialise(dealt.mapInArrow(run, fields), "neighbours")
    heads = all_.where("kind = 2").select(F.col("part").alias("next"), F.col("utf8").alias("following"))
    every = Window.orderBy("next")  # one number for each range
    after = heads.select(F.col("next").alias("part"), F.lead("next").over(every).alias("next"), F.min("next").over(Window.partitionBy()).alias("first"))
    after = after.select("part", F.coalesce("next", "first").alias("next"))
    open_ = all_.where("kind = 1").select("part", "id", "utf8").join(after, "part").join(heads, "next").select("id", "utf8", "following")
    out = StructType.fromDDL(f"id {dealt.schema['id'].dataType.simpleString()}, {_FIELDS}")

    def close(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        maker, schema = SimHash(), to_arrow_schema(out)
        for b in batches:
            for id_, raw, following in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t, f = raw.decode("utf-8", "replace"), following.decode("utf-8", "replace")
                row = (id_, *_digest(t, maker.of(t), f, maker.of(f), maker))
                yield pa.RecordBatch.from_arrays([pa.array([c], x.type) for c, x in zip(row, schema, strict=True)], schema=schema)

    closed = open_.mapInArrow(close, out)
    return all_.where("kind = 0").select(*out.names).unionByName(closed).withColumnRenamed("id", id_col)


def block_masks(radius: int, seed: int = 5) -> list[tuple[int, int]]:
    """(low, high) 64-bit masks of the tables: all pairs of radius + 2 blocks of permuted bits."""
    order = np.random.default_rng(seed).permutation(BITS)
    blocks = [sum(1 << int(i) for i in order[b :: radius + 2]) for b in range(radius + 2)]
    return [(signed((x | y) & (1 << 64) - 1), signed((x | y) >> 64)) for x, y in combinations(blocks, 2)]


def pairs_within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_lo, q_hi, distance, and the index's columns) of all pairs of a query (lo, hi) and a row of the index
    (lo, hi, ...) within the radius, once each; rows of either are distinct fingerprints."""
    masks = block_masks(radius)

    def keyed(df: DataFrame, lo: str, hi: str) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col(lo).bitwiseAND(F.lit(a)), F.col(hi).bitwiseAND(F.lit(b))).alias("k")) for t, (a, b) in enumerate(masks)]
        return df.withColumn("x", F.explode(F.array(*keys))).select("*", "x.*").drop("x")

    q = keyed(queries.select(F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi")), "q_lo", "q_hi")
    x, y = F.col("lo").bitwiseXOR(F.col("q_lo")), F.col("hi").bitwiseXOR(F.col("q_hi"))
    agree = F.array(*[(x.bitwiseAND(F.lit(a)) == 0) & (y.bitwiseAND(F.lit(b)) == 0) for a, b in masks])
    distance = F.bit_count(x) + F.bit_count(y)
    pairs = q.join(keyed(index, "lo", "hi"), ["t", "k"]).where((distance <= radius) & (F.array_position(agree, True) == F.col("t") + 1))
    return pairs.withColumn("distance", distance).drop("t", "k")


def count_within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(lo, hi, n_within) of the queries' distinct fingerprints (lo, hi): how many documents of the index
    (lo, hi, n) lie within the radius, the query's own among them."""
    return pairs_within(queries, index, radius).groupBy(F.col("q_lo").alias("lo"), F.col("q_hi").alias("hi")).agg(F.sum("n").alias("n_within"))


def search(rows: DataFrame, asked: Column, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """rows (id, lo, hi, ...) with n_within, near_id and near_bits where asked holds, null elsewhere.

    n_within counts the documents within the radius, itself included; near_id is the nearest other one: the smallest id of those
    of the same fingerprint (for that one itself the largest), else of those of the nearest fingerprint; near_bits its distance. Null ids are counted but never named.
    """
    ids = F.col(id_col)
    index = rows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(ids).alias("least"), F.max(ids).alias("most"))
    index = materialise(index, "index")
    # Only fingerprints go to all tables; what else is known of them is joined to the pairs found.
    pairs = pairs_within(rows.where(asked).select("lo", "hi").distinct(), index.select("lo", "hi"), radius).join(index, ["lo", "hi"])
    same = F.col("distance") == 0
    other = F.min(F.when(~same & F.col("least").isNotNull(), F.struct("distance", "least")))
    found = pairs.groupBy(F.col("q_lo").alias("lo"), F.col("q_hi").alias("hi")).agg(F.sum("n").alias("n_within"), other.alias("other"), F.min(F.when(same, F.struct("least", "most"))).alias("own"))
    twin = F.when(ids == F.col("own.least"), F.nullif("own.most", "own.least")).otherwise(F.col("own.least"))
    given = rows.join(found, ["lo", "hi"], "left").withColumn("twin", twin)
    added = {"n_within": F.col("n_within"), "near_id": F.coalesce("twin", "other.least"), "near_bits": F.when(F.col("twin").isNotNull(), F.lit(0)).otherwise(F.col("other.distance"))}
    return given.withColumns({c: F.when(asked, v) for c, v in added.items()}).drop("other", "own", "twin")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; those whose ids are divisible by 100 are searched for among all (n_within, near_id, near_bits)."""
    rows = materialise(with_next(documents(spark, sf_dir)), "fingerprints")
    out = search(rows, F.col("doc_id") % 100 == 0)
    # The packed bytes in order, low word first, as in edited_fingerprint.
    word = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    turned = lambda c: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(word(c), i, F.lit(2))), "")
    return out.select("doc_id", "n_chars", "edited_sha256", F.concat(turned("lo"), turned("hi")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "n_within", "near_id", "near_bits")


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
