"""What the two operators on repeated passages share: from seeds to runs of windows worth a closer look.

1. Each document yields its seeds (winnow.py): a window can be repeated only if its seed is.
2. Seeds are counted over the corpus; a document keeps those that occur twice or more.
3. Documents with such seeds yield runs: consecutive windows with one seed, with the units they cover.
4. Runs that are alike are merged into the first of them, which is the earliest place of all of its
   windows, so that the others are repeated as a whole. Counts and minima are combined before shuffles.
5. A seed whose runs are all alike is settled by that; runs of other seeds differ around a common core,
   and their windows are compared one by one by the operator at hand.

A place is (id, hash of the text, start); identical rows are one document, so that they share a result,
and rows that repeat an id with another text are ordered by that hash. A null id comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import materialise
from .winnow import Powers, Winnowed, mix

_U = np.uint64
KEY = ["k_id", "k_text"]


@dataclass(frozen=True)
class Units:
    """What windows are made of. values(texts) gives, laid end to end, a 64-bit value of each unit, the
    number of units of each text, and something that body() cuts runs out of."""

    span: int
    levels: tuple[int, ...]
    values: Callable
    body: Callable  # (held, values, first units, numbers of windows, powers) -> list of bytes
    batch: int


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("k_id"), F.xxhash64(t).alias("k_text"), t.cast("binary").alias("utf8"))


def groups(batches, columns: int, limit: int):
    """Rows of record batches, gathered until their texts (the last column) hold `limit` bytes."""
    held, size = [[] for _ in range(columns)], 0
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(columns)]
        for row in zip(*cols, strict=True):
            for h, x in zip(held, row, strict=True):
                h.append(x)
            size += len(row[-1] or b"")
            if size >= limit:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def _flat(lists: np.ndarray, owners: np.ndarray, n: int):
    """An Arrow list column with n lists: the entries of each owner, owners in order."""
    import pyarrow as pa

    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owners, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.view(np.int64)))


def seeds(docs: DataFrame, units: Units) -> DataFrame:
    """(k_id, k_text, seeds): the distinct seeds of each document's windows, one that occurs again twice."""
    schema = docs.select(*KEY).schema.add("seeds", ArrayType(LongType()))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, powers = to_arrow_schema(schema), Powers()
        for ids, hashes, texts in groups(batches, 3, units.batch):
            values, lengths, _ = units.values(texts)
            owner, seed = Winnowed(values, lengths, units.span, units.levels[0], powers).selected()
            order = np.lexsort((seed, owner))
            owner, seed = owner[order], seed[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
            keep = new.copy()
            keep[1:] |= new[:-1] & ~new[1:]  # the second of its kind
            yield pa.RecordBatch.from_arrays([pa.array(ids, out.field(0).type), pa.array(hashes, pa.int64()), _flat(seed[keep], owner[keep], len(ids)).cast(out.field(2).type)], schema=out)

    return docs.mapInArrow(run, schema)


def alive(found: DataFrame) -> DataFrame:
    """(k_id, k_text, alive) of the documents that have seeds which the corpus repeats."""
    each = found.select(*KEY, F.explode("seeds").alias("seed"))
    twice = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    return each.join(twice, "seed").groupBy(*KEY).agg(F.collect_set("seed").alias("alive"))  # at most the document's own seeds


def runs(docs: DataFrame, living: DataFrame, units: Units) -> DataFrame:
    """(seed, run, k_id, k_text, start, n, self, body): runs of windows with living seeds.

    run is a hash of what the run covers; self tells that one of its windows may occur twice in it; body is
    there for the first of its kind that a task meets.
    """
    joined = docs.join(living, (docs.k_text == living.k_text) & docs.k_id.eqNullSafe(living.k_id)).select(docs.k_id, docs.k_text, "alive", "utf8")
    fields = StructType.fromDDL("seed bigint, run bigint, k_id {}, k_text bigint, start int, n int, self boolean, body binary".format(docs.schema["k_id"].dataType.simpleString()))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, powers, met = to_arrow_schema(fields), Powers(), set()
        for ids, hashes, living_, texts in groups(batches, 4, units.batch):
            values, lengths, held = units.values(texts)
            w = Winnowed(values, lengths, units.span, units.levels[0], powers)
            if not w.inside.any():
                continue
            first_level = w.seeds.copy()
            for k in units.levels[1:]:
                deeper = Winnowed(values, lengths, units.span, k, powers)
                w.seeds = mix(w.seeds * _U(3) + deeper.seeds)
            longest = units.span - units.levels[0] + 1
            at, n, seed = w.runs(longest)
            owner = np.searchsorted(w.starts, at, side="right") - 1
            # Keep a run if its document's living seeds have its own.
            lists = [np.array(x, np.int64).view(np.uint64) for x in living_]
            of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            pool = np.unique(mix(np.concatenate(lists) + mix(of.astype(np.uint64))))
            mine = mix(first_level[at] + mix(owner.astype(np.uint64)))
            k = np.minimum(np.searchsorted(pool, mine), len(pool) - 1)
            keep = pool[k] == mine
            at, n, seed, owner = at[keep], n[keep], seed[keep], owner[keep]
            if not len(at):
                continue
            # Whether the first-level seed stands at two places of the run.
            hit = _places(w.hashes, first_level, at, n, longest)
            whole = rolling_runs(values, at, n + (units.span - 1), powers)
            run_hash = mix(whole + seed)
            new = np.array([not (h in met or met.add(h)) for h in run_hash.tolist()], bool)
            if len(met) > 300_000:
                met.clear()
            bodies = np.empty(len(at), object)
            bodies[new] = units.body(held, values, at[new], n[new], powers)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seed.view(np.int64)), pa.array(run_hash.view(np.int64)), pa.array([ids[o] for o in owner], out.field(2).type), pa.array(np.array(hashes, np.int64)[owner]),
                    pa.array((at - w.starts[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hit), pa.array(bodies.tolist(), pa.binary()),
                ],
                schema=out,
            )

    return joined.mapInArrow(run, fields)


def rolling_runs(values: np.ndarray, at: np.ndarray, length: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[at : at + length] for each run."""
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values) * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[at + length] - sums[at]) * down[at] + length.astype(np.uint64))


def _places(hashes: np.ndarray, seeds_: np.ndarray, at: np.ndarray, n: np.ndarray, per: int) -> np.ndarray:
    """Whether a run's seed is the hash of two or more of the k-grams within the run."""
    lengths = n + per - 1
    total = int(lengths.sum())
    out = np.zeros(len(at), bool)
    step = max(1, int(len(at) * 4_000_000 / max(total, 1)))
    for a in range(0, len(at), step):
        ln = lengths[a : a + step]
        starts = np.cumsum(ln) - ln
        index = np.arange(int(ln.sum())) - np.repeat(starts - at[a : a + step], ln)
        same = hashes[np.minimum(index, len(hashes) - 1)] == np.repeat(seeds_[at[a : a + step]], ln)
        out[a : a + step] = np.add.reduceat(same.astype(np.int32), starts) > 1
    return out


def still_alive(found: DataFrame) -> DataFrame:
    """The runs whose seed at the last level occurs twice or more, or may do so within the run."""
    counts = found.groupBy("seed").agg((F.count(F.lit(1)) + F.max(F.col("self").cast("int"))).alias("m")).where("m > 1").select("seed")
    return found.join(counts, "seed")


def settle(found: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): ranges (k_id, k_text, a, b) of runs that an earlier one equals, and the first runs
    (seed, run, k_id, k_text, start, n, body, kinds) that need a closer look; kinds is their seed's number of them."""
    place = F.struct("k_id", "k_text", "start")
    firsts = found.groupBy("seed", "run").agg(F.min(place).alias("first"), F.max("self").alias("self"), F.first("n").alias("n"))
    firsts = materialise(firsts, "firsts")
    lean = found.select("seed", "run", *KEY, "start", "n")
    again = lean.join(firsts.select("seed", "run", "first"), ["seed", "run"]).where(~place.eqNullSafe(F.col("first")))
    repeated = again.select(*KEY, F.col("start").alias("a"), (F.col("start") + F.col("n") + (span - 1)).alias("b"))
    mixed = firsts.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.max("self").alias("any")).where("kinds > 1 OR any").select("seed", "kinds")
    looked = firsts.drop("self").join(mixed, "seed")
    bodies = found.where("body IS NOT NULL").select("seed", "run", "body")
    opened = looked.join(bodies, ["seed", "run"]).select("seed", "run", "first.*", "n", "kinds", "body")
    return repeated, materialise(opened, "open")


def by_windows(windows: DataFrame, span: int) -> DataFrame:
    """Ranges (k_id, k_text, a, b) of windows (seed, h, k_id, k_text, start) that also start earlier."""
    place = F.struct("k_id", "k_text", "start")
    firsts = windows.groupBy("seed", "h").agg(F.min(place).alias("first"))
    again = windows.join(firsts, ["seed", "h"]).where(~place.eqNullSafe(F.col("first")))
    return again.select(*KEY, F.col("start").alias("a"), (F.col("start") + span).alias("b"))


def gathered(ranges: DataFrame, keep: Callable = materialise) -> DataFrame:
    """(k_id, k_text, ranges): all ranges of each document, at most as many as it has units."""
    return keep(ranges.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")


def joined(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def without(docs: DataFrame, ranges: DataFrame, digest: Callable, fields: str, id_col: str) -> DataFrame:
    """(id, fields) of digest(utf8, joined ranges) for each row of docs."""
    kind = docs.schema["k_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"{id_col} {kind}, {fields}")
    both = docs.join(ranges, (docs.k_text == ranges.k_text) & docs.k_id.eqNullSafe(ranges.k_id), "left").select(docs.k_id, "ranges", "utf8")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for b in batches:
            rows = [(i, *digest(t, joined(r))) for i, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    return both.mapInArrow(run, schema)


def search(docs: DataFrame, units: Units) -> tuple[DataFrame, DataFrame]:
    """settle() of the runs of keyed docs, with each step's table in the shared folder."""
    living = materialise(alive(materialise(seeds(docs, units), "seeds")), "alive")
    found = materialise(runs(docs, living, units), "runs")
    if len(units.levels) > 1:
        found = materialise(still_alive(found), "runs")
    return settle(found, units.span)
