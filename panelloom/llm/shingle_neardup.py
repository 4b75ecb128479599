"""Near-duplicates from a Jaccard similarity of word shingles on: SimHash links and MinHash bands, decided by the sets.

A text's set holds the hashes of its runs of five words. Candidates come from two sides. The covering masks of
covering_lsh.py give every pair of SimHashes of these sets within RADIUS bits; such pairs are very alike or short. At a
similarity of 0.8, though, about a seventh of a SimHash's bits differ, and masks for such a radius are too many (2^(r + 1)
tables). So BANDS keys, each over ROWS minima of the set under random permutations, bring a pair of similarity s together
with probability 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8. All pairs are then compared by the two sets, and linked from
LEAST on. Equal sets are merged first. A bucket with more members than `limit` is not paired at once: its members are
compared with a few hubs, and the links found join most of them into classes. What is asked for are the classes, so pairs
within one need no comparing. A set alike to one of another class shares one of the rarest fifth of its hashes, so sets meet
over these alone (prefixes), which texts that have no more than a common passage don't share; sizes, and the hashes that no
other class has, rule out more. So every alike pair across the classes is found. Hashes of sets have 32 bits: of a set of n, another's
random ones meet n / 2^32, so similarities of texts of a million words come out about 0.02 % too high.

Defined cases: a text without words has an empty set and links to its like; a text of fewer words than a
shingle is one shingle; null ids, repeated rows, long texts, other columns and empty tables are as in covering_lsh.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, scratch, small_join
from .components import connected_components
from .covering_lsh import join_components, keep_chosen, least_of, links, majority, shingle_hashes, signed, with_hash

WIDTH = 5
LEAST = 0.8
RADIUS = 2
BANDS, ROWS = 24, 5
HUBS = 4
#: Members, and hashes, of a block of a large bucket; two blocks are compared at a time.
BLOCK, BLOCK_TERMS = 256, 50_000
_U = np.uint64


class MinHash:
    """Keys of the bands of a set of hashes."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.turn, self.times = draw.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
        self.times |= _U(1)

    def keys(self, hashes: np.ndarray, chunk: int = 512) -> np.ndarray:
        least = np.full(BANDS * ROWS, ~_U(0))
        for i in range(0, len(hashes), chunk):
            x = hashes[i : i + chunk, None] ^ self.turn
            x *= self.times
            np.minimum(least, x.min(axis=0), out=least)
        rows = least.reshape(BANDS, ROWS)
        key = np.zeros(BANDS, np.uint64)
        for k in range(ROWS):
            key = (key ^ rows[:, k]) * _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(29)
        return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k_text, fp, sim, keys, terms): a hash of the set, its SimHash, the bands' keys, and the set as 32-bit hashes."""

    def make():
        import xxhash

        maker = MinHash()

        def of(ids, texts):
            fps, sims, keys, terms = [], [], [], []
            for t in texts:
                h = np.unique(shingle_hashes(t, WIDTH))
                fps.append(signed(xxhash.xxh64_intdigest(h.tobytes())) if len(h) else 0)
                sims.append(signed(majority(h)))
                keys.append(maker.keys(h))
                terms.append(np.unique((h >> _U(32)).astype(np.uint32)).view(np.int32))
            return [fps, sims, keys, terms]

        return of

    return map_texts(with_hash(docs, id_col, text), make, "fp long, sim long, keys array<long>, terms array<int>", id_col, text, ("k_text",))


def by_simhash(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (fp, sim): of nodes with one SimHash each with the first, and of the first ones of SimHashes within the radius."""
    first = materialise(nodes.groupBy("sim").agg(F.min("fp").alias("first")), "sims")
    same = nodes.join(first, "sim").where("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = links(first.select(F.col("sim").alias("fp")), radius)
    ends = [first.select(F.col("sim").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return same.unionByName(near)


def bucket_pairs(rows: DataFrame, limit: int = 32) -> tuple[DataFrame, DataFrame]:
    """From rows (fp, path, bucket): pairs (a, b), a < b, that meet in a bucket, or with a hub of one above limit; and the rows of these."""
    sizes = rows.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialise(rows.join(sizes, ["path", "bucket"]), "buckets")
    few, many = rows.where(F.col("n") <= limit), rows.where(F.col("n") > limit)
    x, y = (few.select("path", "bucket", F.col("fp").alias(c)) for c in "ab")
    found = x.join(y, ["path", "bucket"]).where("a < b").select("a", "b")
    # Hubs are members of many large buckets: the least edited ones of a group of copies, to which most others link.
    reach = many.groupBy("fp").agg(F.count(F.lit(1)).alias("reach"))
    turn = F.xxhash64(F.lit(1), "fp")
    first = [F.max_by("fp", F.when(F.pmod(turn, F.lit(HUBS)) == s, F.struct("reach", turn))).alias(f"h{s}") for s in range(HUBS)]
    hubs = many.join(reach, "fp").groupBy("path", "bucket").agg(*first)
    stars = many.join(hubs, ["path", "bucket"]).select("fp", F.explode(F.array(*[f"h{s}" for s in range(HUBS)])).alias("hub"))
    return found.unionByName(stars.where("fp != hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))), many


def links_of(nodes: DataFrame, least: float = LEAST, limit: int = 32) -> DataFrame:
    """Links (a, b) that join the nodes (fp, sim, keys, terms) into classes: candidates from SimHashes and bands that the sets confirm."""
    pairs, many = bucket_pairs(nodes.select("fp", F.posexplode("keys").alias("path", "bucket")), limit)
    pairs = materialise(pairs.unionByName(by_simhash(nodes)).distinct(), "pairs")
    # The sets that any comparison needs are taken from the nodes once, not for each one.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp"), F.lit(False).alias("crowded")).unionByName(many.select("fp", F.lit(True).alias("crowded")))
    sets = materialise(nodes.select("fp", "terms").join(wanted.groupBy("fp").agg(F.max("crowded").alias("crowded")), "fp"), "sets")
    found = materialise(confirmed(pairs, sets, least), "found")
    if many.isEmpty():
        return found
    stars = materialise(connected_components(found), "classes")
    more = across(sets.where("crowded").select("fp", "terms"), stars, least, limit)
    return stars.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b").unionByName(more)


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(term, fp, root, size, slack): of each set (fp, root, size, terms) the terms of which an alike set of another class has at least one.

    A set alike to x has least * |x| of its terms, so it has one of any (1 - least) * |x| + 1 of them. Those are taken that
    come first in one order of all terms: terms of one class only, which no other class has, then by the number of sets.
    The former are counted, not returned; slack is the number of terms in which x may differ from others, less them.
    """
    terms = sets.select("fp", "root", F.explode("terms").alias("term"))
    shared = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    met = terms.select("fp", "term").join(shared.select("term", "n"), "term")
    order = met.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("order"))  # a text's own terms
    size = F.col("size")
    own = size - F.size("order")
    take = (size - F.ceil(size * F.lit(least) - 1e-6) + 1 - own).cast("int")
    slack = size * F.lit((1 - least) / (1 + least)) - own
    rows = order.join(sets.select("fp", "root", "size"), "fp").where(take > 0).withColumn("slack", slack)
    return rows.select("fp", "root", "size", "slack", F.explode(F.slice("order", F.lit(1), take)["term"]).alias("term"))


def across(nodes: DataFrame, stars: DataFrame, least: float = LEAST, limit: int = 32) -> DataFrame:
    """Links (a, b), a < b, of nodes (fp, terms), those of large buckets, of different classes (node, root).

    Such nodes share a term of their prefixes. Those of a term in few prefixes are paired, and the sets decide. Where more
    prefixes have a term, their sets are dealt to blocks, and two blocks at a time are compared in one group of bounded
    size; only links leave it.
    """
    sets = nodes.select("fp", F.size("terms").alias("size"), "terms")
    sets = sets.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sets = materialise(sets, "open")
    rows = materialise(prefixes(sets, least), "prefixes")
    blocks = F.lit(1) + F.greatest(F.floor(F.col("n") / BLOCK), F.floor(F.col("terms") / BLOCK_TERMS))
    heaps = rows.groupBy("term").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("terms"))
    heaps = materialise(heaps.where("low < high").select("term", "n", blocks.cast("int").alias("blocks")), "heaps")
    few = rows.join(heaps.where(F.col("n") <= limit).select("term"), "term")
    x, y = (few.select("term", *[F.col(k).alias(f"{k}_{c}") for k in ("fp", "root", "size", "slack")]) for c in "ab")
    fit = (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-6) & (F.col("slack_a") + F.col("slack_b") >= -1e-6)
    pairs = x.join(y, "term").where(F.expr("fp_a < fp_b AND root_a != root_b") & fit).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    found = confirmed(materialise(pairs.distinct(), "pairs"), sets, least)
    heaps = heaps.where(F.col("n") > limit).select("term", "blocks")
    if heaps.isEmpty():
        return found
    dealt = small_join(rows, heaps, "term", "inner").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select("fp", "terms"), "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    return found.unionByName(dealt.groupBy("term", "low", "high").applyInPandas(lambda g: links_between(g, least), "a long, b long").distinct())


def links_between(group, least: float):
    """Links of one block's members, or of those of two blocks."""
    import pandas as pd

    low, high = int(group["low"].iat[0]), int(group["high"].iat[0])
    fp, size, slack, root, block = (group[c].to_numpy() for c in ("fp", "size", "slack", "root", "block"))
    sets = [frozenset(t.tolist()) for t in group["terms"]]
    second = np.flatnonzero(block == high)
    out = []
    for i in np.flatnonzero(block == low):
        j = second[(root[second] != root[i]) & (slack[second] + slack[i] >= -1e-6)]
        if low == high:
            j = j[j > i]
        j = j[np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]) - 1e-6]
        for k in j.tolist():
            both = len(sets[i] & sets[k])
            if both >= least * (len(sets[i]) + len(sets[k]) - both) - 1e-9:
                out.append((min(fp[i], fp[k]), max(fp[i], fp[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those pairs (a, b) whose sets (fp, terms) have a Jaccard similarity of at least `least`."""
    x, y = sets.select(F.col("fp").alias("a"), F.col("terms").alias("x")), sets.select(F.col("fp").alias("b"), F.col("terms").alias("y"))
    size = F.size
    possible = F.least(size("x"), size("y")) >= least * F.greatest(size("x"), size("y")) - 1e-6
    both = size(F.array_intersect("x", "y"))
    enough = F.when(possible, both >= least * (size("x") + size("y") - both) - 1e-9).otherwise(F.lit(False))
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, limit: int = 32) -> DataFrame:
    """(id, k_text, fp, root, component): component is the smallest id that the document reaches over links."""
    made = materialise(sketches(docs, id_col, text), "sketches")
    nodes = made.groupBy("fp").agg(F.min(id_col).alias("least"), F.any_value("sim").alias("sim"), F.any_value("keys").alias("keys"), F.any_value("terms").alias("terms"))
    nodes = materialise(nodes, "nodes")
    return join_components(made.select(id_col, "k_text", "fp"), nodes.select("fp", "least"), links_of(nodes, least, limit), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with one document of each component, that of the smallest id."""
    with scratch(docs.sparkSession) as keep:
        chosen = least_of(near_duplicates(docs, id_col, text, least), keep, id_col)
    return keep_chosen(docs, chosen, id_col, text)
