"""Compact blocks of grams: words as codes, frequent ones short.

The codes of the most frequent words, by the frequency that a sample shows, are the same in all tasks; a block
lists the hashes of its other words. Which words the sample holds changes sizes only, never results.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words with a code of their own, and characters of text, about, that the sample of them has.
COMMON = 1 << 19
SAMPLE_CHARS = 64_000_000


def common_words(source: DataFrame, chars: int, make_words) -> np.ndarray:
    """Hashes of frequent words, the most frequent first; source has one binary column, chars bytes long in all."""

    def run(batches):
        import pyarrow as pa

        words, found = make_words(), []
        for b in batches:
            found += [words.of(t or b"") for t in b.column(0).to_pylist()]
        if found:
            word, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    share = min(1.0, SAMPLE_CHARS / max(1, chars))
    some = source.sample(share, 7) if share < 1 else source
    counts = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "word").limit(COMMON).select("word").toArrow()
    return np.array(got.column(0).to_pylist(), np.int64).view(np.uint64)


class Coding:
    """Codes of word hashes: common words by rank, others after them in order of their hash."""

    def __init__(self, common: np.ndarray):
        self.common = common
        self.rank = np.argsort(common)
        self.sorted = common[self.rank]

    def encode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each code, codes)."""
        code = np.empty(len(words), np.int64)
        hit = np.zeros(len(words), bool)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
            hit = self.sorted[at] == words
            code[hit] = self.rank[at[hit]]
        rare, which = np.unique(words[~hit], return_inverse=True)
        code[~hit] = len(self.common) + which
        return np.concatenate([self.common, rare]), code


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Number and bytes of the byte planes of small non-negative numbers, up to the highest that is used."""
    used = -(-int(x.max(initial=0)).bit_length() // 8)
    return used, np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes()


def _number(planes: int, raw: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    if planes:
        out[:, :planes] = np.frombuffer(raw, np.uint8, planes * n, at).reshape(planes, n).T
    return out.view("<u8").ravel().astype(np.int64), at + planes * n


def pack(hashes: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray], common: int) -> bytes:
    """A block of grams, best in the order of their last codes but one, then their last."""
    import zstandard

    every = np.concatenate(codes)
    rare = every >= common
    own, which = np.unique(every[rare], return_inverse=True)
    every[rare] = common + which
    columns = list(every.reshape(len(codes), -1))
    lead = max(0, len(codes) - 2)
    step = np.diff(columns[lead], prepend=0)
    columns[lead] = np.where(step < 0, -2 * step - 1, 2 * step)
    # The other words' hashes are in order, too, as codes are.
    parts = [_planes(np.diff(hashes[own], prepend=np.uint64(0))), *[_planes(c) for c in (*columns, *values)]]
    head = json.dumps([len(values[0]), len(codes), [p for p, _ in parts], len(own)]).encode()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(b"".join(b for _, b in parts))


def unpack(blobs: list[bytes], common: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hash of each code, columns of codes, columns of values) of all grams of some blocks."""
    import zstandard

    heads, rare, raw = [], [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        size, width, planes, words = json.loads(b[4 : 4 + n])
        block = zstandard.ZstdDecompressor().decompress(b[4 + n :], max_output_size=1 + words * planes[0] + size * sum(planes[1:]))
        x, at = _number(planes[0], block, words, 0)
        rare.append(np.cumsum(x.view(np.uint64)))
        heads.append((size, width, planes[1:], at))
        raw.append(block)
    own = np.unique(np.concatenate(rare))
    columns: list[list[np.ndarray]] = [[] for _ in heads[0][2]]
    for (n, width, planes, at), words, block in zip(heads, rare, raw, strict=True):
        to = len(common) + np.searchsorted(own, words)
        for k, p in enumerate(planes):
            x, at = _number(p, block, n, at)
            if k == max(0, width - 2):
                x = np.cumsum(np.where(x & 1, -(x >> 1) - 1, x >> 1))
            if k < width and len(to):
                x = np.where(x >= len(common), to[np.maximum(x - len(common), 0)], x)
            columns[k].append(x)
    whole = [np.concatenate(c) for c in columns]
    return np.concatenate([common, own]), whole[: heads[0][1]], whole[heads[0][1] :]


def gather(blobs: list[bytes], limit: int):
    """Lists of blocks of about `limit` bytes together."""
    held, size = [], 0
    for b in blobs:
        held.append(b)
        size += len(b)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
