"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its byte trigrams, runs of four kinds of characters (letters of either case, digits, space, each
sign for itself; equal kinds in a row count once) and the event that a word repeats the one before it, counted in `BINS`
hashed bins. A truncated singular value decomposition of the labelled texts' counts (rows of length one) spans the latent
space. Labelled vectors are broadcast; every document is compared with each of them, block by block, and the labels
of its `NEIGHBOURS` most similar ones (and of all that are as similar as the last) vote, weighted by a power of their cosine.

Learning uses the labelled texts of the smallest id hashes, `LABELLED` at most (documented bound), so what reaches the driver and is
broadcast has at most LABELLED x BINS counts and LABELLED x RANK numbers. Nothing else is learned or counted from the corpus.

Exact products: the basis is rounded to multiples of 2^-20 and latent vectors, scaled to length one, to multiples of 1 / 2047,
so all sums are of whole numbers that floating point holds exactly. Scores don't depend on how rows are dealt to batches.

Defined cases: a null text counts as empty; an empty text has no neighbours and gets the share of good labels, as does what is
unlike every labelled text; without labels every score is 0.5; a label with a null id or quality teaches nothing, an id labelled
more than once is good only if all its labels are; of rows that share a labelled id the smallest text teaches; a text of any length is
read whole, in pieces of 2^16 bytes that carry on where the one before ended; repeated rows each get their row; only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, text_of
from .language_id import remainder

BINS = 1 << 13
RANK = 32
LABELLED = 4096
NEIGHBOURS = 16
POWER = 8
#: Weight of the share of good labels beside the neighbours' votes.
PRIOR = 0.5
GOOD = 0.7
PIECE = 1 << 16
BLOCK = 64
_UNIT, _BASIS = 2047, 1 << 20

_SPACE = 0
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 1
_P = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(PIECE, _P, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(PIECE, pow(_P, -1, 1 << 64), np.uint64)])
_MASK = (1 << 64) - 1


def _hashed(x: np.ndarray, n: int, odd: int, bins: int) -> np.ndarray:
    """The bin of each run of n values of a byte each, n at most 4."""
    size = max(0, len(x) - n + 1)
    h = x[:size]
    for k in range(1, n):
        h = (h << np.uint32(8)) | x[k : k + size]
    return (h * np.uint32(odd)) >> np.uint32(33 - bins.bit_length())


class _Counter:
    """Counts terms of one text, piece by piece; what a piece leaves open is carried to the next."""

    def __init__(self, bins: int):
        self.bins, self.counts = bins, np.zeros(bins)
        self.last = np.array([32], np.uint32)  # the last two bytes
        self.kinds = np.array([_SPACE], np.uint32)  # the last three kinds, equal ones in a row once
        self.open: tuple[int, int] | None = None  # hash and length of a word that may go on
        self.word: int | None = None  # hash of the word before

    def feed(self, piece: np.ndarray) -> None:
        bytes_ = np.concatenate([self.last, piece.astype(np.uint32)])
        kind = _KIND[piece]
        turns = kind[np.r_[kind[:1] != self.kinds[-1], kind[1:] != kind[:-1]]]
        kinds = np.concatenate([self.kinds, turns.astype(np.uint32)])
        terms = _hashed(bytes_, 3, 2654435761, self.bins), _hashed(kinds, 4, 2246822519, self.bins)
        self.counts += np.bincount(np.concatenate(terms), minlength=self.bins)
        self.last, self.kinds = bytes_[-2:], kinds[-3:]
        self._words(piece, kind != _SPACE)

    def _words(self, piece: np.ndarray, inside: np.ndarray) -> None:
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * _POWERS[: len(piece)], out=sums[1:])
        words = (sums[b] - sums[a]) * _INVERSE[a]
        if self.open is not None:
            own, size = self.open
            if len(a) and a[0] == 0:
                words[0] = np.uint64((own + pow(_P, size, 1 << 64) * int(words[0])) & _MASK)
                first = size + int(b[0])
            else:
                words, first = np.r_[np.uint64(own), words], None
        else:
            first = None
        self.open = None
        if len(b) and b[-1] == len(piece) and inside[-1]:
            whole = first is not None and len(a) == 1
            self.open = int(words[-1]), first if whole else int(b[-1] - a[-1])
            words = words[:-1]
        if len(words):
            self._repeats(words)

    def _repeats(self, words: np.ndarray) -> None:
        n = int((words[1:] == words[:-1]).sum()) + (self.word == int(words[0]))
        self.counts[0] += n  # the event's bin, shared with what hashes there
        self.word = int(words[-1])

    def done(self) -> np.ndarray:
        if self.open is not None:
            self._repeats(np.array([self.open[0]], np.uint64))
        self.feed(np.array([32], np.uint8))
        return self.counts


def term_counts(text: bytes, bins: int = BINS) -> np.ndarray:
    c = _Counter(bins)
    if not text:
        return c.counts
    x = np.frombuffer(text, np.uint8)
    for i in range(0, len(x), PIECE):
        c.feed(x[i : i + PIECE])
    return c.done()


@dataclass(frozen=True)
class Model:
    """basis: bins x rank whole numbers; vectors: rank x labelled whole numbers; norms: their lengths; good: labels, 0 or 1."""

    basis: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    good: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.good.mean()) if len(self.good) else 0.5


def latent(counts: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of whole numbers: directions of the texts in the latent space; zeros for a text without terms."""
    x = counts @ basis
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.rint(_UNIT * x / np.maximum(size, 1e-300))


def decompose(rows: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors (columns) of rows, by subspace iteration."""
    q = np.random.default_rng(0).normal(size=(rows.shape[1], min(rank + 16, rows.shape[1]))).astype(np.float32)
    for _ in range(rounds + 1):
        q = np.linalg.qr(rows.T @ (rows @ q))[0]
    return q @ np.linalg.svd(rows @ q, full_matrices=False)[2].T[:, :rank]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", bound: int = LABELLED) -> DataFrame:
    """(id, good, text): at most `bound` labelled texts of docs, those of the smallest id hashes."""
    i = F.col(f"`{id_col}`")
    known = labels.where(i.isNotNull() & F.col("quality").isNotNull()).groupBy(i.alias("id")).agg(F.min("quality").alias("good"))
    known = known.join(docs.select(i.alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(bound)
    own = docs.select(i.alias("id"), text_of(text).alias("text")).join(F.broadcast(known), "id")  # at most `bound` rows
    return own.groupBy("id", "good").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", bound: int = LABELLED, rank: int = RANK, bins: int = BINS) -> Model:
    """The model of the labelled ones among docs."""

    def make():
        def run(_, texts):
            each = [term_counts(t, bins) for t in texts]
            at = [np.flatnonzero(c) for c in each]
            return [[a.astype("<u2").tobytes() for a in at], [c[a].astype("<i8").tobytes() for c, a in zip(each, at, strict=True)]]

        return run

    own = map_texts(labelled(docs, labels, id_col, text, bound), make, "at binary, n binary", "id", also=("good",))
    found = sorted(own.collect(), key=lambda r: r["id"])  # at most `bound` rows of at most `bins` counts
    rows = np.zeros((len(found), bins), np.float32)
    for k, r in enumerate(found):
        rows[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<i8")
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    keep = size > 0
    rows, size, good = rows[keep], size[keep], np.array([float(r["good"] == 1) for r in found])
    if not len(rows):
        return Model(np.zeros((bins, 1)), np.zeros((1, 0), np.float32), np.zeros(0), good)
    rows /= size[:, None]
    basis = np.rint(_BASIS * decompose(rows, rank).astype(np.float64))
    vectors = np.concatenate([latent(np.rint(rows[i : i + BLOCK] * size[i : i + BLOCK, None]).astype(np.float64), basis) for i in range(0, len(rows), BLOCK)])
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return Model(basis, np.ascontiguousarray(vectors.T, np.float32), np.maximum(norms, 1.0), good[keep])


def votes(x: np.ndarray, m: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The score of each latent vector: labels of its neighbours, weighted by similarity."""
    own = np.maximum(np.sqrt((x * x).sum(axis=1)), 1.0)
    cosine = (x.astype(np.float32) @ m.vectors).astype(np.float64) / (own[:, None] * m.norms)  # whole products below 2^24: exact
    n = cosine.shape[1]
    least = np.partition(cosine, max(0, n - neighbours), axis=1)[:, max(0, n - neighbours)] if n else np.zeros(len(x))
    row, col = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
    w = cosine[row, col] ** POWER
    total, good = (np.bincount(row, v, minlength=len(x)) for v in (w, w * m.good[col]))
    return (good + PRIOR * m.prior) / (total + PRIOR)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, *also, score): how likely each text is good, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bins x rank and rank x LABELLED numbers

    def make():
        def run(_, texts):
            m, out = sent.value, []
            for i in range(0, len(texts), BLOCK):
                counts = np.array([term_counts(t, len(m.basis)) for t in texts[i : i + BLOCK]])
                out.append(votes(latent(counts, m.basis), m))
            return [np.concatenate(out).tolist() if out else []]

        return run

    return map_texts(docs, make, "score double", id_col, text, also)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where("NOT held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, also=("held_out",)).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


QUERIES = {"op11_quality_classifier": op11_quality_classifier}
