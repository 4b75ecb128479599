"""Selecting the same places in equal stretches of text, wherever they stand.

A window of `span` units contains span - k + 1 k-grams; its seed is the smallest of their hashes. Equal
windows have equal seeds, and consecutive windows mostly share theirs, so a text has few seeds.
Everything works on many texts laid end to end.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the base of the rolling hash and of its inverse modulo 2^64, made longer as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(m, _U(base & int(_TOP)))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def rolling(values: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of each run of k values (64-bit, already well mixed)."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers.to(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up, dtype=np.uint64, out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= down[: n - k + 1]
    return mix(h)


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Smallest (or largest) of each `width` consecutive values: block-wise running minima from both sides."""
    pick, pad = (np.minimum, _TOP) if least else (np.maximum, _U(0))
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    m = -(-n // width) * width
    padded = np.full(m, pad)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


class Winnowed:
    """Seeds of all windows of texts that are laid end to end.

    hashes: of each k-gram; seeds: of each window start; inside: whether the window lies in one text.
    """

    def __init__(self, values: np.ndarray, lengths: np.ndarray, span: int, k: int, powers: Powers):
        self.span, self.k, self.lengths = span, k, lengths
        self.starts = np.cumsum(lengths) - lengths
        hashes = rolling(values, k, powers)
        self.hashes = np.minimum(hashes, _TOP - _U(1))
        per = span - k + 1
        self.seeds = sliding(self.hashes, per)
        self.inside = np.zeros(len(self.seeds), bool)
        fits = lengths >= span
        change = np.zeros(len(self.seeds) + 1, np.int32)
        np.add.at(change, self.starts[fits], 1)
        np.add.at(change, (self.starts + lengths - span + 1)[fits], -1)
        self.inside = np.cumsum(change[:-1]).astype(bool)

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of each k-gram that is the seed of a window around it, ties included."""
        if not self.inside.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        per = self.span - self.k + 1
        # The largest seed of the windows around a k-gram equals its hash only if it is a seed itself.
        seeds = np.where(self.inside, self.seeds, _U(0))
        padded = np.zeros(len(self.hashes) + per - 1, np.uint64)
        padded[per - 1 : per - 1 + len(seeds)] = seeds
        at = np.flatnonzero(sliding(padded, per, least=False) == self.hashes)
        return np.searchsorted(self.starts, at, side="right") - 1, self.hashes[at]

    def runs(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, seed) of the runs of windows with one seed, cut at `longest`."""
        seeds, inside = self.seeds, self.inside
        if not inside.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        edge = np.r_[True, (seeds[1:] != seeds[:-1]) | (inside[1:] != inside[:-1])]
        edge[self.starts[(self.starts < len(edge)) & (self.lengths > 0)]] = True
        at = np.flatnonzero(edge)
        n = np.diff(np.r_[at, len(seeds)])
        ok = inside[at]
        at, n = at[ok], n[ok]
        pieces = -(-n // longest)
        if (pieces > 1).any():
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, n = np.repeat(at, pieces) + within * longest, np.minimum(longest, np.repeat(n, pieces) - within * longest)
        return at, n, seeds[at]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def byte_values(text: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values of bytes."""
    return _BYTES[text]
