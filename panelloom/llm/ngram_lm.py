"""Interpolated modified Kneser-Ney model of any order: counted in Spark, kept as sorted hash arrays that workers map.

Counting. Each task hashes its words (64 bits), counts its own n-grams and sends them in blocks by piece; a
block holds codes of words (coding.py), not the words. A gram's piece follows from its last word but one and a salt of
its last word, of which there are more the larger the corpus is, so that a frequent word's grams are spread. An n-gram and
what is left of it without its first word, down to two words, so have one piece, which counts them all: the n-grams'
occurrences, and of each shorter gram the distinct words before it. It writes a file for each length to the shared folder
and sends on, to the pieces of contexts, how many followers of which counts it knows of each gram without its last
word, and of single words also their predecessors. Only counts of counts, a dozen numbers for each length,
reach the driver. The number of pieces grows with the corpus, a piece doesn't, as long as no pair of words alone fills one;
where there are very many, blocks go to them in two steps, so that none gets tiny.

Files. A piece's file holds 32 bits of each key's hash in sorted order, under a table that starts a
bucket for every 16 keys or so, and a byte, or half of one for single counts, that tells which of the most frequent rows of
counts a key has; other rows are on the side. With the piece and the bucket about 50 bits of hash tell grams apart: one lookup in 10^8 finds another
gram's counts.

Scoring. Workers map the files, a bounded number at a time, and look up the distinct grams of many documents piece
by piece. The highest order has raw counts, the lower ones count distinct predecessors, each with its own modified
Kneser-Ney discounts; what the discounts leave of single words is spread evenly over the vocabulary and one unknown word.

Defined cases: a null or empty text is its end token alone; a null id hashes like an empty one and is a
training document; a text of any length is counted and scored whole; repeated rows count and are scored each; ties don't
arise; an empty training set has no words, and every token then has probability one, in both scores; other columns
are never read.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import tempfile
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .coding import Coding, common_words, gather, pack, unpack
from .common import documents, map_texts, new_path
from .language_id import remainder

_U = np.uint64
BEGIN, END = 0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127  # of no word's bytes; a clash is as likely as any of two hashes
SEED = 42
ORDER = 3
CHUNK = 1_500_000  # tokens that a worker counts at once
LOOKUP = 1_200_000  # tokens that a worker looks up at once
KEEP = 300_000  # words whose hashes a worker keeps
PIECE_CHARS = 4_000_000  # characters of corpus for each piece
FAN = 8192  # pieces that a task's blocks go to in one step
MOST = 16  # words of a gram
OPEN = 96  # files that a worker maps at once
BUCKET = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(29))


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each gram, given its words' hashes column by column."""
    key = _mix(columns[0])
    for c in columns[1:]:
        key = _mix(key * _U(0xD6E8FEB86659FD93) + _mix(c))
    return key


def gram_piece(columns: list[np.ndarray], pieces: int) -> np.ndarray:
    """The piece of each gram: of its last word, or of the word before it and a salt of the last."""
    last = _mix(columns[-1] ^ _U(0x2545F4914F6CDD1D)) >> _U(33)
    if len(columns) > 1:
        last = _mix(_mix(columns[-2]) + last % _U(-(-pieces // 8)) * _U(0x9E3779B97F4A7C15)) >> _U(33)
    return last % _U(pieces)


class Words(dict):
    """Hashes of words, kept for frequent use up to a bound."""

    def __init__(self, keep: int = 500_000):
        import xxhash

        self.keep, self.hash = keep, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word, SEED)
        if len(word) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def padded(docs: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end, each after order - 1 begin tokens and with its end token; and where its first token is."""
    head, tail = np.full(order - 1, BEGIN, np.uint64), np.array([END], np.uint64)
    line = np.concatenate([x for d in docs for x in (head, d, tail)])
    return line, np.cumsum([order - 1, *[len(d) + order for d in docs[:-1]]])


def _tokens(line: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Positions of real tokens."""
    real = np.ones(len(line), bool)
    for k in range(1, order):
        real[starts - k] = False
    return np.flatnonzero(real)


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and each key's number among them."""
    order = np.argsort(keys)
    heads = _heads(keys[order])
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(keys)]))
    first = order[heads]
    return keys[first], first, which


def _sums(key: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, their codes, and each column of values summed up."""
    order = np.argsort(key)
    key = key[order]
    at = _heads(key)
    first = order[at]
    return key[at], [c[first] for c in codes], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _count(docs: list[np.ndarray], order: int, coding: Coding) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes of the codes, columns of codes, [count]) of the distinct n-grams, in the order that pack() likes."""
    line, starts = padded(docs, order)
    hashes, code = coding.encode(line)
    ends = _tokens(line, starts, order)
    rank = code[ends - 1] * len(hashes) + code[ends]
    for k in range(2, order):
        rank = _distinct(rank)[2] * len(hashes) + code[ends - k]
    at = np.argsort(rank)
    heads = _heads(rank[at])
    first = ends[at[heads]]
    return hashes, [code[first - k] for k in range(order - 1, -1, -1)], [np.diff(np.r_[heads, len(rank)])]


def _blocks(hashes: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray], pieces: int, common: int, fan: int | None = None):
    """(place, block) of these grams, whose number of words the place tells too: the piece or, with a fan, the first step's part of pieces."""
    place = gram_piece([hashes[c] for c in codes], pieces)
    if fan:
        place = place % _U(fan)
    order = np.argsort(place.astype(np.uint16) if (fan or pieces) <= 1 << 16 else place, kind="stable")
    place = place[order]
    cuts = np.r_[_heads(place), len(place)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        yield int(place[a]) * MOST + len(codes), pack(hashes, [c[own] for c in codes], [v[own] for v in values], common)


class Folder:
    """Files under a shared path: written in one step each, mapped where the path is a file system's own."""

    def __init__(self, uri: str):
        self.uri, self.open, self.held = uri, OrderedDict(), None
        url = urlparse(uri)
        self.local = url.path if url.scheme in ("", "file") else None

    def _fs(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.uri)

    def write(self, name: str, blob: list[bytes]) -> None:
        temp = f"{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{temp}", "wb") as f:
                f.writelines(blob)
            os.replace(f"{self.local}/{temp}", f"{self.local}/{name}")
            return
        fs, root = self._fs()
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/{temp}") as f:
            for b in blob:
                f.write(b)
        fs.move(f"{root}/{temp}", f"{root}/{name}")

    def map(self, name: str) -> Piece | None:
        """The file's arrays, or none if no task had anything to write; the last OPEN ones stay mapped."""
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path = f"{self.local}/{name}"
        if self.local is None:  # a copy for this worker, while it is mapped
            from pyarrow.fs import FileType

            fs, root = self._fs()
            if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                return None
            self.held = self.held or tempfile.TemporaryDirectory()
            path = f"{self.held.name}/{name}"
            with fs.open_input_stream(f"{root}/{name}") as src, open(path, "wb") as f:
                while block := src.read(1 << 22):
                    f.write(block)
        found = None
        if os.path.exists(path):
            with open(path, "rb") as f:
                found = Piece(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
            if self.local is None:
                os.unlink(path)  # its space is free again once it is no longer mapped
        self.open[name] = found
        if len(self.open) > OPEN:
            self.open.popitem(last=False)
        return found


def piece_file(key: np.ndarray, columns: list[np.ndarray]) -> list[bytes]:
    """A piece's file: sorted keys as buckets of 32-bit rests, and rows of counts."""
    bits = max(0, (len(key) // BUCKET).bit_length() - 1)
    top = (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    packed, small = np.zeros(len(key), np.int64), np.ones(len(key), bool)
    for c in columns:
        packed = packed << 8 | np.minimum(c, 255)
        small &= c < 256
    kinds, which, n = np.unique(packed[small], return_inverse=True, return_counts=True)
    other = 15 if len(columns) == 1 else 255
    frequent = np.argsort(-n, kind="stable")[:other]
    slot = np.full(len(kinds), other, np.uint8)
    slot[frequent] = np.arange(len(frequent))
    row = np.full(len(key) + len(key) % 2, other, np.uint8)
    row[: len(key)][small] = slot[which]
    more = np.flatnonzero(row[: len(key)] == other)
    row = row[::2] | row[1::2] << 4 if other == 15 else row
    table = [kinds[frequent] >> 8 * k & 255 for k in range(len(columns) - 1, -1, -1)]
    parts = [np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.uint32), (key >> _U(32 - bits)).astype(np.uint32), row, more.astype(np.uint32), *table, *[c[more].astype(np.min_scalar_type(c[more].max(initial=0))) for c in columns]]
    head = json.dumps([bits, [[p.dtype.str, len(p)] for p in parts]]).encode()
    out = [len(head).to_bytes(8, "little"), head + b" " * (-len(head) % 8)]
    for p in parts:
        out += [p.tobytes(), b"\0" * (-p.nbytes % 8)]
    return out


class Piece:
    """A mapped piece file."""

    def __init__(self, data: mmap.mmap):
        n = int.from_bytes(data[:8], "little")
        self.bits, shapes = json.loads(data[8 : 8 + n])
        at, parts = 8 + n + -n % 8, []
        for kind, size in shapes:
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes + -parts[-1].nbytes % 8
        self.starts, self.rests, self.row, self.more = parts[:4]
        width = (len(parts) - 4) // 2
        self.table, self.side = parts[4 : 4 + width], parts[4 + width :]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1; a binary search of all keys at once."""
        if not len(self.rests):
            return np.full(len(key), -1)
        top = (key >> _U(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(key), np.int32)
        want = (key >> _U(32 - self.bits)).astype(np.uint32)
        at, end = self.starts[top].astype(np.int32), self.starts[top + 1].astype(np.int32)
        step = 1 << int((end - at).max(initial=0)).bit_length() >> 1
        while step:
            ahead = at + np.int32(step)
            np.copyto(at, ahead, where=(self.rests.take(ahead - 1, mode="clip") < want) & (ahead <= end))
            step >>= 1
        hit = (at < end) & (self.rests.take(at, mode="clip") == want)
        return np.where(hit, at, -1)

    def take(self, place: np.ndarray) -> list[np.ndarray]:
        """The columns of counts at these places."""
        single = len(self.table) == 1
        row = self.row[place >> 1] >> ((place & 1) << 2) & 15 if single else self.row[place]
        big = np.flatnonzero(row == (15 if single else 255))
        at = np.searchsorted(self.more, place[big])
        out = []
        for few, side in zip(self.table, self.side, strict=True):
            c = np.append(few, np.zeros(256 - len(few), np.int64))[row]
            c[big] = side[at]
            out.append(c)
        return out


def _by_piece(batches):
    """(piece, blobs) for each piece of a stream that is sorted by piece."""
    now, held = None, []
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append(blob)
    if held:
        yield now, held


def _rows(rows):
    """Record batches of (piece, blob), a few MB each."""
    import pyarrow as pa

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["piece", "blob"])

    ids, blobs, size = [], [], 0
    for p, blob in rows:
        ids.append(p)
        blobs.append(blob)
        size += len(blob)
        if size > 1 << 23:
            yield batch()
            ids, blobs, size = [], [], 0
    if ids:
        yield batch()


_SCHEMA = "piece long, blob binary"


def train(docs: DataFrame, text: str = "text", order: int = ORDER, piece_chars: int = PIECE_CHARS, fan: int = FAN) -> dict:
    """Count the model; returns its folder, sizes and discounts. The files stay in the shared folder."""
    if not 2 <= order < MOST:
        raise ValueError(f"order is from 2 to {MOST - 1}")
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    pieces = max(1, -(-chars // piece_chars))
    first = fan if pieces > fan else None
    uri = new_path(spark, "grams")
    source = docs.select(F.col(f"`{text}`").cast("binary").alias("utf8"))
    sent = spark.sparkContext.broadcast(common_words(source, chars, Words))  # at most coding.COMMON numbers

    def count(batches):
        words, held, size, coding = Words(KEEP), [], 0, Coding(sent.value)

        def sends(docs):
            return _blocks(*_count(docs, order, coding), pieces, len(coding.common), first)

        def blocks():
            nonlocal held, size
            for b in batches:
                for t in b.column(0).to_pylist():
                    held.append(words.of(t or b""))
                    size += len(held[-1]) + order
                    if size >= CHUNK:
                        yield from sends(held)
                        held, size = [], 0
            if held:
                yield from sends(held)

        yield from _rows(blocks())

    def deal(batches):
        """The second step to very many pieces: blocks of one part of them are taken apart, a few MB at a time."""
        common = sent.value

        def out():
            for p, blobs in _by_piece(batches):
                if p < 0:  # totals
                    yield from ((p, b) for b in blobs)
                    continue
                for some in gather(blobs, 1 << 25):
                    hashes, codes, values = unpack(some, common)
                    _, codes, values = _sums(gram_key([hashes[c] for c in codes]), codes, values)
                    yield from _blocks(hashes, codes, values, pieces, len(common))

        yield from _rows(out())

    def settle(batches):
        """Sum up pieces of n-grams and all shorter grams down to two words, write them, and send on what they know of contexts."""
        folder, common, seen = Folder(uri), sent.value, Totals()

        def out():
            for p, blobs in _by_piece(batches):
                hashes, codes, values = unpack(blobs, common)

                def send(codes, values, hashes=hashes):
                    _, codes, values = _sums(gram_key([hashes[c] for c in codes]), codes, values)
                    line = np.lexsort([*codes[:-2], *codes[-1:], *codes[-2:-1]])
                    return _blocks(hashes, [c[line] for c in codes], [v[line] for v in values], pieces, len(common), first)

                key, codes, (n,) = _sums(gram_key([hashes[c] for c in codes]), codes, values)
                times = n
                for level in range(order, 1, -1):
                    folder.write(f"{level}-{p // MOST}", piece_file(key, [n]))
                    seen.kinds(level, n)
                    followers = [n, *[f.astype(np.int64) for f in (n == 1, n == 2, n >= 3)]]
                    one = np.ones(len(n), np.int64)
                    if level > 2:
                        yield from send(codes[:-1], followers)
                        # A shorter gram's count is that of the distinct words before it.
                        key, codes, (n, times) = _sums(gram_key([hashes[c] for c in codes[1:]]), codes[1:], [one, times])
                    else:
                        none = np.zeros(len(n), np.int64)
                        both = zip((one, times, none, none, none, none), (none, none, *followers), strict=True)
                        yield from send([np.concatenate([codes[1], codes[0]])], [np.concatenate(x) for x in both])
            yield from seen.rows()

        yield from _rows(out())

    def finish(batches):
        """Sum up contexts and words, write them, and report totals."""
        folder, common, seen = Folder(uri), sent.value, Totals()
        for p, blobs in _by_piece(batches):
            if p < 0:
                seen.add(blobs)
                continue
            hashes, codes, values = unpack(blobs, common)
            key, _, values = _sums(gram_key([hashes[c] for c in codes]), codes, values)
            folder.write(f"context{p % MOST}-{p // MOST}", piece_file(key, values))
            if p % MOST == 1:
                before = values[0][values[0] > 0]  # the begin token is a context, but no word
                seen.kinds(1, before)
                seen.add([json.dumps({"tokens": int(values[1].sum()), "types": len(before), "pairs": int(before.sum()), "more": int((before >= 3).sum())})])
        yield from _rows(seen.rows())

    def moved(found: DataFrame) -> DataFrame:
        if first:
            found = found.repartition(first, "piece").sortWithinPartitions("piece").mapInArrow(deal, _SCHEMA)
        return found.repartition(pieces, "piece").sortWithinPartitions("piece")

    found = moved(moved(source.mapInArrow(count, _SCHEMA)).mapInArrow(settle, _SCHEMA)).mapInArrow(finish, _SCHEMA)
    # A few rows of a dozen totals each; summed up in Spark.
    pair = F.explode(F.from_json(F.col("blob").cast("string"), "map<string,bigint>"))
    total = {r[0]: r[1] for r in found.select(pair).groupBy("key").agg(F.sum("value")).collect()}
    return {"uri": uri, "order": order, "pieces": pieces} | {k: total.get(k, 0) for k in ("tokens", "types", "pairs")} | {
        "low_counts": [total.get("1:1", 0), total.get("1:2", 0), total.get("more", 0)],
        "discounts": [discounts([total.get(f"{level}:{k}", 0) for k in range(1, 5)]) for level in range(1, order + 1)],
    }


class Totals(dict):
    """Sums by name that tasks pass on."""

    def kinds(self, level: int, n: np.ndarray) -> None:
        for k in range(1, 5):
            self[f"{level}:{k}"] = self.get(f"{level}:{k}", 0) + int((n == k).sum())

    def add(self, blobs: list) -> None:
        for b in blobs:
            for k, v in json.loads(b).items():
                self[k] = self.get(k, 0) + v

    def rows(self) -> list[tuple[int, bytes]]:
        return [(-1, json.dumps(self).encode())] if self else []


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]  # too few counts to tell: fixed ones, below the counts they are taken from
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c > 0, c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


class Model:
    """The files of one trained model, mapped as they are asked for."""

    def __init__(self, info: dict):
        self.info, self.folder = info, Folder(info["uri"])

    def _look(self, columns: list[np.ndarray], key: np.ndarray, names: list[str], widths: list[int]) -> list[np.ndarray]:
        """The counts of grams in the files of each name, zero where a gram is unknown."""
        out = [[np.zeros(len(key), np.int64) for _ in range(w)] for w in widths]
        piece = gram_piece(columns, self.info["pieces"]).astype(np.int64)
        order = np.argsort(piece.astype(np.uint16) if self.info["pieces"] <= 1 << 16 else piece, kind="stable")
        cuts = np.r_[_heads(piece[order]), len(piece)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            wanted = key[own]
            for name, columns_ in zip(names, out, strict=True):
                data = self.folder.map(f"{name}-{piece[own[0]]}")
                if data is None:
                    continue
                place = data.find(wanted)
                hit = np.flatnonzero(place >= 0)
                for o, c in zip(columns_, data.take(place[hit]), strict=True):
                    o[own[hit]] = c
        return [c for columns_ in out for c in columns_]

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: tokens, known tokens, base score, model score (log10)."""
        i = self.info
        line, starts = padded(docs, i["order"])
        real = _tokens(line, starts, i["order"])
        n, v, pairs = i["tokens"], i["types"], i["pairs"]
        p = back = total = None
        for level in range(1, i["order"] + 1):
            # Grams that end at each position; before the first token only begin tokens stand.
            ends = np.arange(i["order"] - 2, len(line)) if level < i["order"] else real
            columns = [line[ends - k] for k in range(level - 1, -1, -1)]
            key, first, which = _distinct(gram_key(columns))
            columns = [c[first] for c in columns]
            place = np.zeros(len(line), np.int64)
            place[ends] = which
            at, d = place[real], i["discounts"][level - 1]
            if level == 1:
                before, seen, *followers = self._look(columns, key, ["context1"], [6])
                base, known = np.log10((seen + 1) / (n + v + 1))[at], (seen > 0)[at]
                n1, n2, more = i["low_counts"]
                low = _discounted(before, d) / pairs + (d[0] * n1 + d[1] * n2 + d[2] * more) / pairs / (v + 1) if pairs else np.full(len(key), 1.0 / (v + 1))
                p = low[at]
            else:
                c, *followers = self._look(columns, key, [str(level), f"context{level}"], [1, 4]) if level < i["order"] else self._look(columns, key, [str(level)], [1])
                p = _discounted(c, d)[at] / np.maximum(total, 1) + back * p
            if level < i["order"]:  # this level's grams are the next one's contexts
                many, one, two, more = followers
                d = i["discounts"][level]
                share = np.where(many > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(many, 1), 1.0)
                ahead = place[real - 1]
                total, back = many[ahead], share[ahead]
        heads = np.searchsorted(real, starts)
        sums = lambda x: np.add.reduceat(x, heads)
        return sums(np.ones(len(real), np.int64)), sums(known.astype(np.int64)), sums(base), sums(np.log10(p))


def score_texts(docs: DataFrame, info: dict, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, *also, n_tokens, n_known, train_tokens, base_score, score)."""

    def make():
        words, model = Words(KEEP), Model(info)

        def run(_, texts):
            out = [[] for _ in range(5)]
            held, size = [], 0

            def flush() -> None:
                if held:
                    n, known, base, score = model.score(held)
                    for o, x in zip(out, (n, known, np.full(len(n), info["tokens"]), base, score), strict=True):
                        o.extend(x.tolist())
                    held.clear()

            for t in texts:
                held.append(words.of(t))
                size += len(held[-1]) + 1
                if size >= LOOKUP:
                    flush()
                    size = 0
            flush()
            return out

        return run

    return map_texts(docs, make, "n_tokens long, n_known long, train_tokens long, base_score double, score double", id_col, text, also)


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10.0, -score / n_tokens)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder("doc_id", 7) == 2)
    return score_texts(docs, train(docs.where("NOT held_out")), also=("held_out",))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
