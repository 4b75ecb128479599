"""Removing repeated strings with suffix arrays.

Every byte covered by a string of `span` bytes that also starts earlier in the corpus goes. Candidates come
from repeats.py: runs of windows around a common seed. Runs are dealt by seed to shards of a few MB; equal
windows have equal seeds, so no match crosses shards. Each shard is laid end to end, its suffix array is
built by induced sorting, common prefixes are computed in text order, and neighbours that share `span` bytes
form groups, in which all but the earliest start are repeated. Runs that are alike are merged before that,
and a seed with very many different runs (over `crowd`) is split further: its windows are compared as rows,
keyed by 128 bits, which spreads over all tasks.

Defined cases: a null text is empty; texts shorter than span lose nothing; repeated rows (same id, same
text) are one document and share a result; rows that repeat an id with another text are ordered by a hash
of the text; a null id comes first; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, scratch
from .induced_sort import permuted_lcp, suffix_array
from .repeats import KEY, Units, by_windows, gathered, keyed, search, without
from .winnow import Powers, byte_values, mix, rolling

SPAN = 100
SEED_BYTES = 32
SHARD_BYTES = 2_500_000
CROWD = 8_000  # different runs of one seed, beyond which its windows are compared as rows
_U = np.uint64


def _values(texts: list[bytes]):
    raw = b"".join(texts)
    return byte_values(np.frombuffer(raw, np.uint8)), np.array([len(t) for t in texts], np.int64), raw


def _units(span: int, k: int) -> Units:
    def body(raw, _values, at, n, _powers):
        return [raw[a : a + m + span - 1] for a, m in zip(at.tolist(), n.tolist(), strict=True)]

    return Units(span, (k,), _values, body, 400_000)


def shard_ranges(bodies: list[bytes], windows: np.ndarray, doc: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(run number, window within the run) of each window that equals one which starts earlier.

    Run i has the bytes bodies[i], its first windows[i] positions start a window, and it stands at
    start[i] of the document with rank doc[i].
    """
    lengths = np.array([len(b) for b in bodies], np.int64)
    raw = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8)
    at = np.cumsum(lengths + 1) - (lengths + 1)
    text = raw.astype(np.int16) + 1
    text[at + lengths] = 0  # between runs
    used = np.flatnonzero(np.bincount(text, minlength=257))
    code = np.zeros(257, np.int32)
    code[used] = np.arange(1, len(used) + 1)
    coded = np.empty(len(text) + 1, np.int32)
    coded[:-1] = code[text]
    coded[-1] = 0
    sa = suffix_array(coded)
    own = np.repeat(np.arange(len(bodies)), lengths + 1)
    offset = np.arange(len(raw)) - at[own]
    fresh = np.zeros(len(coded), bool)
    fresh[at] = True
    small = len(used) < 255
    lcp = permuted_lcp(coded.astype(np.uint8) if small else coded, sa, fresh, int(lengths.max()) + span)
    group = np.cumsum(lcp[sa] < span)
    inside = sa < len(raw)
    sa, group = sa[inside], group[inside]
    opens = offset[sa] < windows[own[sa]]
    sa, group = sa[opens], group[opens]
    if not len(sa):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run, off = own[sa], offset[sa]
    place = doc[run].astype(np.int64) * (1 << 40) + start[run] + off
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(place, heads)
    late = place > np.repeat(least, np.diff(np.r_[heads, len(group)]))
    return run[late], off[late]


def _by_suffix_arrays(opened: DataFrame, shards: int, span: int) -> DataFrame:
    """Ranges (k_id, k_text, a, b) of the repeated windows of runs, shard by shard."""
    kind = opened.schema["k_id"].dataType.simpleString()
    fields = StructType.fromDDL(f"k_id {kind}, k_text bigint, a int, b int")
    dealt = opened.select(F.pmod(F.xxhash64("seed"), F.lit(shards)).cast("int").alias("shard"), "run", *KEY, "start", "n", "body")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)

        def solve(rows: dict):
            rows = list(rows.values())
            docs = sorted({r[:2] for r in rows}, key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]))
            rank = {k: i for i, k in enumerate(docs)}
            doc, start = np.array([rank[r[:2]] for r in rows]), np.array([r[2] for r in rows])
            r, off = shard_ranges([r[4] for r in rows], np.array([r[3] for r in rows]), doc, start, span)
            if not len(r):
                return
            place = np.unique(doc[r] * (1 << 40) + start[r] + off)
            edge = np.flatnonzero(np.r_[True, np.diff(place) > 1])
            a, b = place[edge], place[np.r_[edge[1:] - 1, len(place) - 1]] + span
            own = [docs[i] for i in (a >> 40).tolist()]
            low = (1 << 40) - 1
            cols = [[k[0] for k in own], [k[1] for k in own], (a & low).astype(np.int32), (b & low).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        now, held = None, {}
        for b in batches:
            for shard, run_, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now and held:
                    yield from solve(held)
                    held = {}
                now = shard
                held[run_] = tuple(row)  # a run may come from several tasks
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, fields)


def _windows(opened: DataFrame, span: int) -> DataFrame:
    """(seed, h, k_id, k_text, start): each window of crowded runs; h takes in a second hash of its bytes."""
    kind = opened.schema["k_id"].dataType.simpleString()
    fields = StructType.fromDDL(f"seed bigint, h bigint, k_id {kind}, k_text bigint, start int")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, powers = to_arrow_schema(fields), Powers()
        for b in batches:
            for seed, id_, hash_, start, n, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = byte_values(np.frombuffer(body, np.uint8))
                h = rolling(v, span, powers) ^ rolling(mix(v + _U(1)), span, powers)
                cols = [[seed] * n, h.view(np.int64), [id_] * n, [hash_] * n, np.arange(start, start + n, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return opened.dropDuplicates(["seed", "run"]).select("seed", *KEY, "start", "n", "body").mapInArrow(run, fields)


def _digest(text: bytes, ranges: list[tuple[int, int]]) -> tuple:
    kept, at = hashlib.sha256(), 0
    for a, b in ranges:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in ranges), len(ranges), kept.hexdigest()


def repeated_ranges(docs: DataFrame, span: int = SPAN, k: int = SEED_BYTES, shard_bytes: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """(k_id, k_text, ranges) of keyed documents that lose bytes."""
    with scratch(docs.sparkSession) as keep:
        repeated, opened = search(docs, _units(span, k))
        calm = opened.where(F.col("kinds") <= crowd)
        size = calm.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        ranges = repeated.unionByName(_by_suffix_arrays(calm, max(1, -(-size // shard_bytes)), span))
        crowded = opened.where(F.col("kinds") > crowd)
        if not crowded.isEmpty():
            ranges = ranges.unionByName(by_windows(_windows(crowded, span), span))
        return gathered(ranges, keep)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, **how) -> DataFrame:
    """(id, kept binary, n_removed): what is left of each text."""
    own = keyed(docs, id_col, text)

    def kept(t: bytes, ranges: list[tuple[int, int]]) -> tuple:
        out, at = [], 0
        for a, b in ranges:
            out.append(t[at:a])
            at = b
        return b"".join([*out, t[at:]]), sum(b - a for a, b in ranges)

    return without(own, repeated_ranges(own, span, **how), kept, "kept binary, n_removed long", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = keyed(documents(spark, sf_dir), "doc_id", "text")
    return without(own, repeated_ranges(own), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
