"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (n = 1 to 3, lower case, spaces at both ends) are taken for each language over all
training documents in Spark. The matrix of log-probabilities has `bins` rows and a column for each
language, so its size does not depend on the number of documents; it is broadcast in blocks of up to `block`
languages, so that each broadcast is at most bins x block numbers, and workers score whole batches in numpy, block by block.

Defined cases: a null text, or one without a letter (a character of a Unicode category L), is `und` with score 0;
a null language teaches nothing; a null id hashes like an empty one; without any training document everything is
`und`; of languages of equal posterior the first in code-point order is predicted; a text of any length is scored in
pieces of 2^20 characters that overlap, so that every n-gram of the whole text counts once; an empty text has no n-grams; repeated rows each get their row; columns other than those
named are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, materialise

UNKNOWN = "und"
BINS = 1 << 15
ORDERS = (1, 2, 3)
#: Odd multipliers of the rolling combination, one for each position of an n-gram.
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_CHUNK = 1 << 20
_PLAIN = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_PLAIN.search(text)) or any(map(str.isalpha, text))


def pieces(text: str) -> Iterator[str]:
    """The text in lower case with a space at both ends, in pieces that share the characters of n-grams across their ends."""
    padded = f" {text.lower()} "
    for i in range(0, len(padded) if text else 0, _CHUNK):
        yield padded[i : i + _CHUNK + max(ORDERS) - 1]


def piece_bins(piece: str, bins: int = BINS) -> np.ndarray:
    """The bin of each n-gram that starts among the piece's first _CHUNK characters, repeats included."""
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - bins.bit_length() + 1)
    out = []
    for n in ORDERS:
        size = min(_CHUNK, len(points) - n + 1)
        if size <= 0:
            continue
        h = np.full(size, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        for k in range(n):
            h = (h ^ points[k : size + k]) * _MIX[k]
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(2654435761)) >> shift)
    return np.concatenate(out)


def gram_bins(text: str, bins: int = BINS) -> np.ndarray:
    """The bin of each n-gram of a text."""
    return np.concatenate([piece_bins(p, bins) for p in pieces(text)] or [np.empty(0, np.uint32)])


def _train_counts(docs: DataFrame, id_col: str, text: str, lang: str, bins: int) -> DataFrame:
    """(lang, bin, n), with bin -1 for the number of documents; summed up within each task first."""

    def run(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}

        def sent():
            for la, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([la] * len(at)), pa.array(np.where(at == bins, -1, at).astype(np.int32)), pa.array(own[at])], names=["lang", "bin", "n"])
            sums.clear()

        for b in batches:
            for la, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(la, np.zeros(bins + 1, np.int64))
                own[bins] += 1
                t = (t or b"").decode("utf-8", "replace")
                for p in pieces(t):
                    own[:bins] += np.bincount(piece_bins(p, bins), minlength=bins)
            if len(sums) > 256:  # of very many languages a task sends what it has, and starts anew
                yield from sent()
        yield from sent()

    known = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("binary").alias("utf8"))
    return known.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


#: A block of languages: their names, log-priors, and log-probabilities (bins x languages, float32).
Block = tuple[list[str], np.ndarray, np.ndarray]


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", bins: int = BINS, alpha: float = 0.1, block: int = 64) -> list[Block]:
    """The model, `block` languages at a time; languages in code-point order."""
    counts = materialise(_train_counts(docs, id_col, text, lang, bins), "grams")
    seen = {r["lang"]: r["n"] for r in counts.where("bin < 0").select("lang", "n").collect()}  # one row for each language
    langs, total, out = sorted(seen), max(1.0, float(sum(seen.values()))), []
    for i in range(0, len(langs), block):
        own = langs[i : i + block]
        table = np.zeros((bins, len(own)))
        for r in counts.where((F.col("bin") >= 0) & F.col("lang").isin(own)).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("each")).collect():  # at most bins in a list
            for x in r["each"]:
                table[x["bin"], own.index(r["lang"])] = x["n"]
        table += alpha
        out.append((own, np.log(np.array([seen[la] for la in own]) / total), np.log(table / table.sum(axis=0)).astype(np.float32)))
    return out


def score_batch(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Sums of log-probabilities, a row for each text: n-grams of many texts are looked up together."""
    out, held, at, size = np.zeros((len(texts), matrix.shape[1])), [], [], 0

    def flush() -> None:
        if held:
            starts = np.cumsum([0, *[len(h) for h in held[:-1]]])
            np.add.at(out, at, np.add.reduceat(matrix[np.concatenate(held)], starts, axis=0, dtype=np.float64))
        held.clear()
        at.clear()

    for k, t in enumerate(texts):
        for p in pieces(t):
            held.append(piece_bins(p, len(matrix)))
            at.append(k)
            size += len(held[-1])
            if size > _CHUNK:
                flush()
                size = 0
    flush()
    return out


def predict(docs: DataFrame, model: list[Block], id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, *also, lang_pred, score): the likeliest language and its posterior probability."""
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in model]

    def make():
        def run(_, texts):
            texts = [t.decode("utf-8", "replace") for t in texts]
            best, top, mass = [UNKNOWN] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts))
            for block in sent:
                langs, prior, matrix = block.value
                s = score_batch(texts, matrix) + prior
                own = s.max(axis=1)
                for k in np.flatnonzero(own > top):
                    best[k] = langs[s[k].argmax()]
                new = np.maximum(top, own)  # mass: of all languages so far, relative to the likeliest
                mass = mass * np.exp(top - new) + np.exp(s - new[:, None]).sum(axis=1)
                top = new
            some = np.array([bool(sent) and has_letter(t) for t in texts], bool)
            return [[la if ok else UNKNOWN for la, ok in zip(best, some, strict=True)], np.where(some, 1 / np.maximum(mass, 1), 0.0).tolist()]

        return run

    return map_texts(docs, make, "lang_pred string, score double", id_col, text, also)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder("doc_id", 4) == 2)
    return predict(docs, fit(docs.where("NOT held_out")), also=("held_out",))


QUERIES = {"op7_language_id": op7_language_id}
