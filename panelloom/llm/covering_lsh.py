"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r each bit position i gets a vector m(i) of r + 1 bits; the mask
of a non-zero vector v keeps the positions with odd <m(i), v>. Any r positions leave some v orthogonal
to all their vectors, so two fingerprints that differ in at most r bits agree under some of the
2^(r+1) - 1 masks: no pair is missed. Equal fingerprints are merged first. A bucket with more members than
`limit` is split by a further family of masks over the bits that its mask left free, for which the same
guarantee holds; after three levels few bits are free, so a bucket can't hold many distinct fingerprints.
Links are then joined into components.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; a text of any length counts whole; a bit that exactly half of the hashes set is 0;
repeated rows and equal texts share a fingerprint and a component; a null id keeps its row, and its component is the
smallest id that it reaches; rows that repeat an id are told apart by their texts; of rows with one id and one text
one can stay; an empty table gives an empty one; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, materialise, scratch, text_of
from .components import connected_components

BITS = 64
SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, joined by a space; of all words if there are fewer; A-Z lowered."""
    from itertools import accumulate

    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.array([h(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), chunk):
        part = hashes[i : i + chunk]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k_text, fp): a hash of each text, and its SimHash as a signed long."""

    def make():
        return lambda ids, texts: [[signed(majority(shingle_hashes(t, width))) for t in texts]]

    return map_texts(with_hash(docs, id_col, text), make, "fp long", id_col, text, ("k_text",))


def with_hash(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text, k_text): k_text tells rows apart that repeat an id."""
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"), F.xxhash64(text_of(text)).alias("k_text"))


def mask_families(radius: int, levels: int = 3, seed: int = 7) -> list[list[int]]:
    """For each level 2^(radius+1) - 1 masks; each level gives the positions other vectors."""
    n = 1 << (radius + 1)
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(levels):
        vectors = np.resize(np.arange(n), BITS)
        draw.shuffle(vectors)
        out.append([sum(1 << i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, n)])
    return out


def links(nodes: DataFrame, radius: int = 2, limit: int = 64, seed: int = 7, levels: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `radius` bits; nodes has distinct fp.

    A bucket above `limit` goes on to the next level of masks instead of being paired; the last level
    pairs all that is left, at most as many as its free bits tell apart.
    """
    found = []
    rows = nodes.select("fp", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("bucket"))
    families = mask_families(radius, levels, seed)
    for level, family in enumerate(families):
        one = [
            F.struct(
                (F.col("path") * len(family) + v).alias("path"),
                F.col("free").bitwiseAND(F.lit(signed(~m & (1 << BITS) - 1))).alias("free"),
                F.xxhash64("bucket", F.col("fp").bitwiseAND(F.col("free")).bitwiseAND(F.lit(signed(m)))).alias("bucket"),
            )
            for v, m in enumerate(family)
        ]
        rows = rows.select("fp", F.explode(F.array(*one)).alias("x")).select("fp", "x.*")
        sizes = rows.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = materialise(rows.join(sizes, ["path", "bucket"]), "buckets")
        fit = rows if level == len(families) - 1 else rows.where(F.col("n") <= limit)
        x, y = fit.select("path", "bucket", F.col("fp").alias("a")), fit.select("path", "bucket", F.col("fp").alias("b"))
        near: Column = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        found.append(x.join(y, ["path", "bucket"]).where(near).select("a", "b"))
        rows = rows.where(F.col("n") > limit).drop("n")
        if level < len(families) - 1 and rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text", limit: int = 64) -> DataFrame:
    """(id, k_text, fp, root, component): component is the smallest id that the document reaches over links."""
    fps = materialise(fingerprints(docs, width, id_col, text), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    return join_components(fps, nodes, links(nodes, radius, limit), id_col)


def join_components(fps: DataFrame, nodes: DataFrame, linked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, k_text, fp, root, component) of rows (id, k_text, fp), given the least id of each fp and the links (a, b) between fps."""
    stars = connected_components(linked)
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(rooted.join(names, "root").select("fp", "root", "component"), "fp").select(id_col, "k_text", "fp", "root", "component")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id."""
    with scratch(docs.sparkSession) as keep:
        chosen = least_of(near_duplicates(docs, width, radius, id_col, text), keep, id_col)
    return keep_chosen(docs, chosen, id_col, text)


def least_of(classes: DataFrame, keep, id_col: str = "doc_id") -> DataFrame:
    """(id, k_text, n) of one document of each class (id, k_text, root): of the smallest id, null last, then the smallest hash; n rows have both."""
    rows = classes.groupBy("root", F.col(id_col).alias("id"), "k_text").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k_text", "n"))
    return keep(rows.groupBy("root").agg(first.alias("x")).select("x.id", "x.k_text", "x.n"), "chosen")


def keep_chosen(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each row of least_of()."""
    # The ids grow with the corpus, so they are never broadcast, however few they are here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(text_of(text)).alias("own_text"))
    same = (F.col("own_text") == F.col("k_text")) & F.col("own_id").eqNullSafe(F.col("id"))
    kept = own.join(chosen.select("id", "k_text").hint("merge"), same, "left_semi")
    if not chosen.where("n > 1").isEmpty():  # an id on several rows of one text: one of them stays
        kept = kept.dropDuplicates(["own_id", "own_text"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op9_simhash_neardup": op9_simhash_neardup}
