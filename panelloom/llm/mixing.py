"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are counted in words. Targets: the sources, in code-point order of their names, weigh 5, 2, 1 in
turn and share `budget` times all words; a target stops at `most` times its source's size and what is
over goes to the others by weight, until none is above.

A source's documents are laid end to end in the order of a hash, and that line is cut into blocks of equally many
words. A source whose target is q times its size and a rest owes every block q times (q full rounds) and, of
one more round, so many blocks as the rest needs. These block quotas, a vector with an entry for each source and
round, are dealt to the output shards: a tree halves the shards and splits the vector between the halves by a
multivariate-hypergeometric draw, down to single shards, and with the quotas it splits each round's permuted
blocks, in proportion. A shard then draws its quota from its own part of the blocks, so that shards are disjoint
and the blocks that are drawn follow from the tree. Of a round's last block only the words are taken that
meet the target, so it is met to the word. Within a shard documents stand in the order of a hash (m_pos).

What is written is what is counted: a document appears whole once for each full round, and once more with as many of its
words as the last round draws of it, as one run of the text with its own white space. In a document that spans at most two
blocks these are the drawn words themselves, unless the cut block lies in it; in a longer one they are as many words in one run
from the first block drawn, so that texts are not spliced.

The tree has two levels, as colours of a multivariate-hypergeometric draw may be pooled and split again: the driver
splits the sums of GROUPS groups of sources, and one task for each group splits its own, given the group's share of
every shard. Neither the number of sources nor that of documents is bounded; the driver sees GROUPS rows.

Everything follows from hashes and seeds, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id is
hashed like an empty one; rows that repeat an id are told apart by their text's hash; identical rows are
interchangeable; a source without words has target 0; a text of any length may span many blocks; an empty table
gives an empty one; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, materialise, small_join, text_of

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
SHARDS = 64
GROUPS = 256
#: Blocks of the whole mix for each shard, at least MIN_WORDS words each.
BLOCKS = 256
MIN_WORDS = 64
#: Documents of one source that one window orders, and bytes of text in one task of the written mix, about.
BUCKET_ROWS = 2_000
TASK_BYTES = 1 << 26


def split_tree(draws: np.ndarray, shard_sizes: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """How many draws of each colour each shard gets (shards x colours): columns sum to draws, rows to shard_sizes."""
    out = np.zeros((len(shard_sizes), len(draws)), np.int64)
    todo = [(0, len(shard_sizes), np.asarray(draws, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        take = int(shard_sizes[lo:mid].sum())
        left = np.random.default_rng((*seed, lo, hi)).multivariate_hypergeometric(have, take, method="marginals") if len(have) else have
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def even(total: int, shards: int) -> np.ndarray:
    """total in parts that differ by at most one."""
    return np.diff(np.arange(shards + 1) * total // shards)


def draw_blocks(blocks: int, quota: np.ndarray, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(block, shard) of each draw: every shard draws its quota from its own part of the permuted blocks."""
    order = np.random.default_rng(seed).permutation(blocks)
    upto = np.cumsum(quota)
    # Parts in proportion to the quotas: at least as long, as blocks >= sum of the quotas.
    ends = upto * blocks // max(1, int(upto[-1]))
    found, shard = [], []
    for s in np.flatnonzero(quota):
        part = order[ends[s - 1] if s else 0 : ends[s]]
        own = np.random.default_rng((*seed, int(s))).permutation(part)[: quota[s]]
        found.append(own)
        shard.append(np.full(len(own), s))
    return np.concatenate(found or [np.empty(0, np.int64)]), np.concatenate(shard or [np.empty(0, np.int64)])


def with_targets(sources: DataFrame, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources (key, size, ...) with rank, from 0 in code-point order, null last, and target.

    Sources that are full at `most` times their size are those of the smallest size for their weight; what is left of
    the budget for each unit of weight follows from sums over them. One row a source goes through these windows.
    """
    order = Window.orderBy(F.col("key").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("w", w)
    full = F.lit(float(most)) * F.col("size")
    up = Window.orderBy(full / F.col("w"), "rank")
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.lit(budget) * F.sum("size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    open_ = F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumns({"full": full, "unit": rest / open_})
    # The first source that its share does not fill settles the unit for itself and all after it.
    unit = F.min_by("unit", F.struct(F.col("full") / F.col("w"), F.col("rank")))
    settled = s.where(F.col("unit") * F.col("w") <= F.col("full")).agg(unit.alias("settled"))
    s = s.crossJoin(F.broadcast(settled))  # one row
    share = F.when(F.col("settled").isNotNull(), F.least(F.col("settled") * F.col("w"), F.col("full"))).otherwise(F.col("full"))
    return s.withColumn("target", share).drop("w", "full", "unit", "settled")


def _plan(sources: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """(rank, block, shards, part, part_shard, upto) of every block of sources (rank, size, target).

    shards: where the block goes in each full round; part: how many words from its start the last round takes,
    for part_shard; upto: the words that this round takes of the blocks before.
    """
    per = F.lit(block_words)
    cells = sources.where("size > 0").select("rank", "size", F.round("target").cast("long").alias("owed"), (F.col("rank") % GROUPS).alias("grp"))
    cells = cells.withColumns({"whole": F.floor(F.col("size") / per), "tail": F.col("size") % per, "rounds": F.expr("owed div size"), "rest": F.expr("owed % size")})
    # The last round draws whole blocks; what is over comes from the source's short last block or, if that is
    # too short, from one more whole block, which is cut.
    over = F.col("rest") % per
    cells = cells.withColumns({"cut": F.when(over > F.col("tail"), over).otherwise(F.lit(0)), "short": F.when(over <= F.col("tail"), over).otherwise(F.lit(0))})
    cells = cells.withColumn("drawn", F.floor(F.col("rest") / per) + (F.col("cut") > 0).cast("long"))
    number = F.col("rounds") * (F.col("whole") + (F.col("tail") > 0).cast("long")) + F.col("drawn") + (F.col("short") > 0).cast("long")
    sums = {r["grp"]: r["n"] for r in cells.groupBy("grp").agg(F.sum(number).alias("n")).collect()}  # GROUPS rows
    totals = np.array([sums.get(g, 0) for g in range(GROUPS)], np.int64)
    sent = sources.sparkSession.sparkContext.broadcast(split_tree(totals, even(int(totals.sum()), shards), (seed,)))  # shards x GROUPS numbers

    def solve(pdf):
        import pandas as pd

        grp = int(pdf["grp"].iloc[0])
        rows = list(pdf.sort_values("rank").itertuples())
        # A colour is a pool of blocks of one source and round, and how many of them are drawn.
        colours = []
        for r in rows:
            blocks = r.whole + (r.tail > 0)
            colours += [(r, k, 0, blocks, blocks) for k in range(r.rounds)]
            colours += [(r, r.rounds, 0, r.whole, r.drawn)] * (r.drawn > 0) + [(r, r.rounds, r.whole, 1, 1)] * (r.short > 0)
        quota = split_tree(np.array([c[4] for c in colours], np.int64), sent.value[:, grp], (seed, 1, grp))
        place: dict[int, list] = {r.rank: [np.zeros((r.whole + (r.tail > 0), r.rounds), np.int64), np.full(r.whole + (r.tail > 0), -1), np.zeros(r.whole + (r.tail > 0), np.int64)] for r in rows}
        for c, (r, k, first, blocks, _) in enumerate(colours):
            block, shard = draw_blocks(blocks, quota[:, c], (seed, 2, r.rank, k, first))
            full, part_shard, part = place[r.rank]
            if k < r.rounds:
                full[block, k] = shard
                continue
            part_shard[first + block] = shard
            part[first + block] = r.short if first == r.whole else block_words
            if first < r.whole and r.cut:
                part[block.max()] = r.cut
        out = []
        for r in rows:
            full, part_shard, part = place[r.rank]
            out.append(pd.DataFrame({"rank": r.rank, "block": np.arange(len(part)), "shards": full.tolist(), "part": part, "part_shard": part_shard, "upto": np.cumsum(part) - part}))
        return pd.concat(out)

    return cells.groupBy("grp").applyInPandas(solve, "rank long, block long, shards array<long>, part long, part_shard long, upto long")


def _tag(c: Column) -> Column:
    """A string that tells null from any text."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), budget: float = BUDGET, most: float = MOST, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 2011, buckets: int | None = None) -> DataFrame:
    """(row, m_size, m_source_size, m_target, m_taken, m_draws): row is a struct of the columns in keep.

    m_taken is the number of words that the mix takes; m_draws has a struct (shard, pos, start, words) for each time that
    words of the document are taken: how many from which word on (from 0), and their place in the shard's order. Their
    words add up to m_taken.
    """
    col = lambda c: F.col(f"`{c}`")
    ident = F.coalesce(col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[col(c) for c in keep]).alias("row"),
        col(source).cast("string").alias("key"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), ident, text_of(text)).alias("pos"),
    )
    if text not in keep:
        rows = materialise(rows, "sizes")
    if buckets is None:  # as many for each source as the largest one needs
        largest = docs.groupBy(col(source)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = -(-largest // BUCKET_ROWS) or 1
    rows = rows.withColumns({"tag": _tag(F.col("key")), "bucket": F.pmod(F.xxhash64(F.lit(1), "pos"), F.lit(buckets))})
    sums = materialise(rows.groupBy("tag", "bucket").agg(F.any_value("key").alias("key"), F.sum("size").alias("words")), "sums")
    sources = with_targets(sums.groupBy("tag").agg(F.any_value("key").alias("key"), F.sum("words").alias("size")), budget, most)
    sources = materialise(sources.select("tag", "rank", F.col("size").alias("source_size"), "target"), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block_words = max(MIN_WORDS, -(-int(budget * total) // (shards * blocks)))
    plan = materialise(_plan(sources.select("rank", F.col("source_size").alias("size"), "target"), block_words, shards, seed), "plan")

    # Where each document starts on its source's line: by the sums of its buckets, and of its own bucket before it.
    line = Window.partitionBy("tag").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("tag", "bucket", F.coalesce(F.sum("words").over(line), F.lit(0)).alias("offset"))
    within = Window.partitionBy("tag", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = small_join(out, offsets, ["tag", "bucket"])
    out = small_join(out, sources, "tag").withColumn("start", F.col("before") + F.col("offset")).drop("before", "offset", "bucket", "tag", "key")
    some = F.col("size") > 0
    for name, at in (("first", F.col("start")), ("mid", F.col("start") + F.expr("(size - 1) div 2")), ("last", F.col("start") + F.col("size") - 1)):
        found = plan.select(F.struct("rank", "block").alias("place"), F.struct("shards", "part", "part_shard", "upto").alias(name))
        out = small_join(out.withColumn("place", F.when(some, F.struct("rank", F.floor(at / block_words).alias("block")))), found, "place", max_rows=100_000).drop("place")
    taken_to = lambda p, at: p["upto"] + F.least(p["part"], at % block_words)  # noqa: E731  of the last round, before `at`
    end = F.col("start") + F.col("size") - 1
    of_last = F.least(F.col("last.part"), end % block_words + 1) + F.col("last.upto") - taken_to(F.col("first"), F.col("start"))
    of_last = F.when(some, of_last).otherwise(F.lit(0)).cast("long")
    taken = F.when(some, F.size("mid.shards") * F.col("size") + of_last).otherwise(F.lit(0)).cast("long")
    # The run that the last round takes starts with the document, or ends where the draw of its last block does, or fills middle blocks.
    ahead = F.lit(block_words) - F.col("start") % block_words  # words up to the first edge of a block
    in_last = end % block_words + 1
    head, tail = F.col("start") % block_words < F.col("first.part"), F.col("last.part") > 0
    begin = F.when(head, F.lit(0)).when(tail, F.col("size") - in_last + F.least(F.col("last.part"), in_last) - of_last).otherwise(ahead)
    middle = F.when(F.col("mid.part") > 0, F.col("mid.part_shard")).otherwise(F.pmod(F.col("pos"), F.lit(shards)))
    to = F.when(head, F.col("first.part_shard")).when(tail, F.col("last.part_shard")).otherwise(middle)
    place = lambda shard, k, begin, words: F.struct(shard.cast("long").alias("shard"), F.xxhash64(F.lit(seed), shard.cast("long"), k, "pos").alias("pos"), begin.cast("long").alias("start"), words.cast("long").alias("words"))
    whole = F.transform(F.coalesce(F.col("mid.shards"), F.array().cast("array<bigint>")), lambda s, k: place(s, k, F.lit(0), F.col("size")))
    draws = F.concat(whole, F.when(of_last > 0, F.array(place(to, F.size(whole), begin, of_last))).otherwise(F.slice(whole, 1, 0)))
    return out.select("row", F.col("size").alias("m_size"), F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"), taken.alias("m_taken"), draws.alias("m_draws"))


def words_of(text: Column, start: Column, words: Column) -> Column:
    """So many words of a text from one on (from 0), with the white space between them."""
    each = F.regexp_extract_all(text, F.lit(f"{WORD}(?:{SPACE})?"), F.lit(0))
    return F.rtrim(F.array_join(F.slice(each, (start + 1).cast("int"), words.cast("int")), ""), F.lit(" \t\n\x0b\f\r"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = 2011, places: bool = False, n_chars: str = "n_chars") -> DataFrame:
    """The mixed documents: one row for each draw, whole or with the words that the last round takes of it.

    So the words written of each document are its m_taken. n_chars, if there, follows where a text is cut; all other columns
    pass through. Rows of a shard stand together in tasks of about TASK_BYTES, dealt to them by a hash and sorted by
    another: the local shuffle. With places, columns m_shard and m_pos are added.
    """
    columns = list(docs.columns)
    out = assign(docs, id_col, text, source, tuple(columns), shards=shards, seed=seed)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = max(1, -(-int(BUDGET * size) // (shards * TASK_BYTES)))  # of a shard
    cut = F.col("d.words") < F.col("m_size")
    of_row = lambda c: F.col("row").getField(c)
    held = [F.when(cut, words_of(of_row(c), F.col("d.start"), F.col("d.words"))).otherwise(of_row(c)) if c == text else of_row(c) for c in columns]
    out = out.select("row", "m_size", F.explode("m_draws").alias("d"))
    out = out.select(*[c.alias(f"c{k}") for k, c in enumerate(held)], cut.alias("cut"), F.col("d.shard").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), "d.pos"), F.lit(parts)).alias("part"), F.col("d.pos").alias("pos"))
    tasks = max(1, min(shards * parts, max(-(-int(BUDGET * size) // TASK_BYTES), 4 * docs.sparkSession.sparkContext.defaultParallelism)))
    out = out.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "pos")
    new_length = F.length(f"c{columns.index(text)}")
    last = [F.when(F.col("cut"), new_length.cast(docs.schema[c].dataType)).otherwise(F.col(f"c{k}")) if c == n_chars else F.col(f"c{k}") for k, c in enumerate(columns)]
    return out.select(*[c.alias(columns[k]) for k, c in enumerate(last)], *([F.col("shard").alias("m_shard"), F.col("pos").alias("m_pos")] if places else []))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), F.col("m_taken").alias("taken"),
        F.transform("m_draws", lambda d: d["shard"]).alias("shards"),
    )


QUERIES = {"op4_mix_sources": op4_mix_sources}
