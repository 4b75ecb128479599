"""Plain versions of the text operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(docs: list[tuple[int, list | bytes]], span: int) -> dict[int, list[bool]]:
    """For each document, in order of ids, which units a window covers that also starts earlier."""
    first, out = {}, {}
    for doc_id, units in sorted(docs, key=lambda d: d[0]):
        gone = [False] * len(units)
        for i in range(len(units) - span + 1):
            window = units[i : i + span] if isinstance(units, bytes) else tuple(units[i : i + span])
            if window in first:
                gone[i : i + span] = [True] * span
            else:
                first[window] = True
        out[doc_id] = gone
    return out


def suffix_rows(texts: dict[int, str | None], span: int = 100) -> dict[int, tuple]:
    raw = {k: (t or "").encode() for k, t in texts.items()}
    out = {}
    for k, gone in removed(list(raw.items()), span).items():
        kept = bytes(b for b, g in zip(raw[k], gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(raw[k]), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passage_rows(texts: dict[int, str | None], span: int = 20) -> dict[int, tuple]:
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    out = {}
    for k, gone in removed(list(words.items()), span).items():
        kept = " ".join(w for w, g in zip(words[k], gone, strict=True) if not g)
        out[k] = (len(words[k]), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(fps: dict[int, int], radius: int) -> dict[int, int]:
    """Smallest id reachable from each over fingerprints within the radius."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def fingerprint(text: str | None, width: int = 3) -> int:
    import xxhash

    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
