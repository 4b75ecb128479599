"""Removing repeated passages of words by level-wise doubling.

A window of 20 words can be repeated only if the windows of 5 and of 10 words in it are. The first level
takes from each window of 20 the 5 words whose hash is smallest; those that the corpus repeats are
extended to twice the length, the 10 words of smallest hash in the window, and counted again; what is
still repeated is extended to the whole 20 words, and no candidate is left after that. Consecutive windows
share their choices and travel as one run; runs that are alike are merged first (repeats.py).

Defined cases: a null text has no words; texts of fewer than 20 words lose nothing; repeated rows (same id,
same text) are one document and share a result; rows that repeat an id with another text are ordered by a
hash of the text; a null id comes first; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, scratch
from .ngram_lm import Words
from .repeats import KEY, Units, by_windows, gathered, keyed, search, without
from .winnow import mix, rolling

SPAN = 20


class _Exact(Words):
    """Hashes of words as they are, not lowered."""

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_WORDS: list[_Exact] = []


def _values(texts: list[bytes]):
    if not _WORDS:
        _WORDS.append(_Exact())
    each = [_WORDS[0].of(t) for t in texts]
    return mix(np.concatenate(each)), np.array([len(x) for x in each], np.int64), None


def levels(span: int, first: int) -> tuple[int, ...]:
    """Lengths from the first on, doubled while they are below the window."""
    out = [first]
    while 2 * out[-1] < span:
        out.append(2 * out[-1])
    return tuple(out)


def _units(span: int, first: int) -> Units:
    def body(_held, values, at, n, powers):
        """Hashes of the run's windows at the last level."""
        h = rolling(values, span, powers)
        return [h[a : a + m].tobytes() for a, m in zip(at.tolist(), n.tolist(), strict=True)]

    return Units(span, levels(span, first), _values, body, 2_000_000)


def _windows(opened: DataFrame) -> DataFrame:
    kind = opened.schema["k_id"].dataType.simpleString()
    fields = StructType.fromDDL(f"seed bigint, h bigint, k_id {kind}, k_text bigint, start int")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        for b in batches:
            if not b.num_rows:
                continue
            seed, ids, hashes, start, n, bodies = (c.to_pylist() for c in b.columns)
            n = np.array(n)
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            h = np.frombuffer(b"".join(bodies), np.int64)
            cols = [np.array(seed)[row], h, [ids[r] for r in row], np.array(hashes)[row], (np.array(start)[row] + within).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return opened.dropDuplicates(["seed", "run"]).select("seed", *KEY, "start", "n", "body").mapInArrow(run, fields)


def repeated_ranges(docs: DataFrame, span: int = SPAN, first: int = 5) -> DataFrame:
    """(k_id, k_text, ranges) of keyed documents that lose words; ranges count words."""
    with scratch(docs.sparkSession) as keep:
        repeated, opened = search(docs, _units(span, first))
        return gathered(repeated.unionByName(by_windows(_windows(opened), span)), keep)


def _kept(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    words, out, at = text.split(), [], 0
    for a, b in ranges:
        out += words[at:a]
        at = b
    return len(words), out + words[at:]


def _digest(text: bytes, ranges: list[tuple[int, int]]) -> tuple:
    n, kept = _kept(text, ranges)
    return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, first: int = 5) -> DataFrame:
    """(id, kept, n_removed): the words left, joined by single spaces."""
    own = keyed(docs, id_col, text)

    def digest(t: bytes, ranges: list[tuple[int, int]]) -> tuple:
        n, kept = _kept(t, ranges)
        return b" ".join(kept).decode("utf-8", "replace"), n - len(kept)

    return without(own, repeated_ranges(own, span, first), digest, "kept string, n_removed long", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = keyed(documents(spark, sf_dir), "doc_id", "text")
    return without(own, repeated_ranges(own), _digest, "n_words long, n_removed long, kept_sha256 string", "doc_id")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
