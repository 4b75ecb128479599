"""SentencePiece BPE by a prefix table.

For each prefix of a text the table holds the last token of the prefix's own encoding. A token t that
ends here (found by an Aho-Corasick automaton over the pieces) is that last token if and only if the
last token of the prefix before t stays next to t when the two are encoded alone; exactly one token
passes. The ids then follow backwards from the end, in time linear in the text.

A text is cut where no piece can reach across: before a space that follows something else, and around
line feeds if no piece has one. Encodings of short cuts are kept in a bounded table for each worker.
The model file is read on the driver and its bytes (a fixed size) are broadcast.

Defined cases: a null or empty text has only the begin and end ids; characters without a piece fall
back to their bytes, or to the unknown id if the model has no byte pieces; repeated rows each get their row.
"""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts

SPACE = "▁"
#: Encodings that a worker keeps, about 300 bytes each; twice as many while it turns them over.
KEEP = 350_000
NORMAL, UNKNOWN_TYPE, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model format


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        value |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of each field of a serialised message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceCodec:
    """Encoder and decoder of one BPE model with the identity normaliser."""

    def __init__(self, model: bytes, keep: int = KEEP):
        import ahocorasick

        self.pieces: list[tuple[str, float, int]] = []
        norm: dict = {}
        self.begin, self.end, self.unknown = 1, 2, 0
        for number, value in _fields(model):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
                self.unknown, self.begin, self.end = (trainer.get(k, v) for k, v in ((40, 0), (41, 1), (42, 2)))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("only the identity normaliser with a leading space is supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches across words")
        one_line = not any("\n" in p for p in self.ids)
        self.cuts = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if one_line else rf"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN_TYPE else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]
        self.pair: dict[tuple[int, int], bool] = {}
        self.tokens = ahocorasick.Automaton()
        # How each piece comes about on its own: its last merge, and when; pieces that never do are left out.
        self.halves: dict[str, tuple[str, str]] = {}
        self.odd: set[str] = set()
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) > 1:
                parts, halves = self._merge(p)
                if parts != [p]:
                    continue
                self.halves[p] = halves
                if any(self._time(h) >= self._time(p) or h in self.odd for h in halves):
                    self.odd.add(p)
            self.tokens.add_word(p, (len(p), i))
        self.spines: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        self.tokens.make_automaton()
        codec, self.keep_pairs = self, 3 * keep

        class Kept(dict):
            """Encodings of short cuts: the last `keep` new ones and those before them that came up again."""

            def __init__(self) -> None:
                self.older: dict[str, tuple[bytes, bytes]] = {}

            def __missing__(self, cut: str) -> tuple[bytes, bytes]:
                got = self.older.get(cut)
                if got is None:
                    ids = codec.encode_cut(cut)
                    got = struct.pack(f"<{len(ids)}I", *ids), codec.raw(ids)
                if len(cut) <= 48:
                    if len(self) >= keep:
                        self.older = dict(self)
                        self.clear()
                    self[cut] = got
                return got

        self.kept = Kept()

    def _merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, best score first, leftmost among equals: the parts, and the last two that were joined."""
        parts, score, halves = list(s), self.score, None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                return parts, halves
            halves = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _time(self, p: str) -> float:
        """Merges happen in this order; characters are there from the start."""
        return float("-inf") if len(p) == 1 else -self.score[p]

    def _spine(self, p: str, side: int) -> list[tuple[str, float, float]]:
        """The parts that stand at one end of p while it comes about: part, from when, until when."""
        found = self.spines.get((p, side))
        if found is None:
            found, part, until = [], p, float("inf")
            while True:
                found.append((part, self._time(part), until))
                if len(part) == 1:
                    break
                part, until = self.halves[part][side], self._time(part)
            self.spines[p, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are: no part at a's end ever joins one at b's start.

        Two parts that stand side by side join if their piece comes before either is used up; at the same
        time, which takes the same piece, the left join goes first.
        """
        found = self.pair.get((a, b))
        if found is None:
            x, y = self.pieces[a][0], self.pieces[b][0]
            if len(self.pair) > self.keep_pairs:
                self.pair.clear()
            if x in self.odd or y in self.odd:
                found = self._merge(x + y)[0] == [x, y]
            else:
                score, left = self.score.get, self._spine(y, 0)
                found = True
                for p, p_from, p_until in self._spine(x, 1):
                    for q, q_from, q_until in left:
                        if p_from < q_until and q_from < p_until and (s := score(p + q)) is not None and -s < p_until and -s <= q_until:
                            found = False
            self.pair[a, b] = found
        return found

    def encode_cut(self, cut: str) -> list[int]:
        """Ids of one cut: the prefix table forwards, the ids backwards."""
        last, size = [-1] * len(cut), [1] * len(cut)  # -1: a character without a piece, which nothing joins
        pair, compatible = self.pair.get, self.compatible
        for end, (n, t) in self.tokens.iter(cut):
            start = end - n
            if start >= 0 and (p := last[start]) >= 0:
                ok = pair((p, t))
                if not (compatible(p, t) if ok is None else ok):
                    continue
            last[end], size[end] = t, n
        out, end = [], len(cut) - 1
        while end >= 0:
            if last[end] >= 0:
                out.append(last[end])
            elif self.byte:
                out.extend(self.byte[x] for x in reversed(cut[end].encode()))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            end -= size[end]
        return out[::-1]

    def raw(self, ids) -> bytes:
        """Bytes of the pieces, spaces in place of their mark."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        """Ids with the begin and end ids."""
        body = self.encode_bytes(text)[0]
        return list(struct.unpack(f"<{len(body) // 4}I", body))

    def encode_bytes(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the bytes that they decode to."""
        got = list(map(self.kept.__getitem__, self.cuts(SPACE + text.replace(" ", SPACE)))) if text else []
        ids = b"".join([struct.pack("<I", self.begin), *[x for x, _ in got], struct.pack("<I", self.end)])
        return ids, self._finish(b"".join([x for _, x in got]))

    def _finish(self, raw: bytes) -> bytes:
        """Without the leading space; bytes that are no UTF-8 become the replacement character."""
        raw = raw[1:] if raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace").encode()

    def decode(self, ids) -> str:
        return self._finish(self.raw(ids)).decode()


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[bytes, PieceCodec] = {}


def codec_of(model: bytes, keep: int = KEEP) -> PieceCodec:
    """The codec of a model, kept for all tasks of a worker."""
    key = hashlib.sha256(model).digest() + str(keep).encode()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model, keep)
    return _CODECS[key]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """(id, *also, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def make():
        import numpy as np

        codec = codec_of(sent.value, keep)

        def run(_, texts):
            n, a, b, ids = [], [], [], []
            for t in texts:
                x, y = codec.encode_bytes(t.decode("utf-8", "replace"))
                n.append(len(x) // 4)
                a.append(hashlib.sha256(x).hexdigest())
                b.append(hashlib.sha256(y).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(x, "<u4").astype(np.int32))
            return [n, a, b, *([ids] if with_ids else [])]

        return run

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, id_col, text, also)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
