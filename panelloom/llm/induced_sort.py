"""Suffix arrays by induced sorting, and common prefixes in text order, on numpy arrays.

Suffixes are classified (S: smaller than the next one, L: larger); the leftmost S of each run (LMS) mark
substrings, which an inducing pass sorts and names; the string of names is sorted recursively; two scans
then induce all suffixes from the sorted LMS ones. A scan works through the buckets of first characters in
turn, as many at once as feed nothing into each other, so that each step is a handful of array operations.

Common prefixes are permuted: computed for text positions in order, where a value follows from the one
before unless the preceding characters differ; only those irreducible ones are compared.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last character is the smallest."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        step = np.sign(t[1:].astype(np.int64) - t[:-1])
        at = np.where(step != 0, np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where characters differ
        s[:-1] = step[np.minimum(at, n - 2)] > 0
    return s


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Stable order by key; keys of two bytes are dealt to places instead of compared."""
    if len(keys) and keys.max() < 1 << 16:
        keys = keys.astype(np.uint16)
    return np.argsort(keys, kind="stable")


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its key, for keys that stand together."""
    n = len(sorted_keys)
    at = np.arange(n)
    new = np.ones(n, bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return at - np.maximum.accumulate(np.where(new, at, 0))


class _Scan:
    """Buckets, and which of them can be worked through at once in either direction."""

    def __init__(self, t: np.ndarray, s: np.ndarray):
        self.t, self.s = t, s
        sigma = int(t.max()) + 1
        self.sizes = np.bincount(t, minlength=sigma)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        here, after = t[:-1], t[1:]
        # The largest smaller bucket that feeds a bucket, and the smallest larger one.
        self.low, self.high = np.full(sigma, -1, np.int64), np.full(sigma, sigma, np.int64)
        if sigma <= 1024:  # few buckets: mark the pairs that occur
            met = np.zeros(sigma * sigma, bool)
            met[here.astype(np.int64) * sigma + after] = True
            here, after = np.divmod(np.flatnonzero(met), sigma)
        fall, rise = here > after, here < after
        np.maximum.at(self.low, here[fall], after[fall])
        np.minimum.at(self.high, here[rise], after[rise])
        self.up = self._batches(self.low)
        down = self._batches((sigma - 1 - self.high)[::-1])
        self.down = [(sigma - b, sigma - a) for a, b in down]

    @staticmethod
    def _batches(feeds: np.ndarray) -> list[tuple[int, int]]:
        """Intervals of buckets none of which is fed by another of its interval, from below."""
        out, a, n = [], 0, len(feeds)
        while a < n:
            b, width = a + 1, 64
            while b < n:
                hit = np.flatnonzero(feeds[b : b + width] >= a)
                if len(hit):
                    b += int(hit[0])
                    break
                b = min(n, b + width)
                width *= 2
            out.append((a, b))
            a = b
        return out

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the LMS ones, which are in order within each bucket."""
        t, s = self.t, self.s
        sa = np.full(len(t), -1, np.int32)
        first = t[lms]
        order = _grouped(first)
        lms, first = lms[order], first[order]
        count = np.bincount(first, minlength=len(self.sizes))
        place = (self.ends - count)[first] + _ranks(first)
        sa[place] = lms
        # From below: the L suffixes, at the front of their buckets.
        free = self.starts.copy()
        for a, b in self.up:
            lo, hi = self.starts[a], self.ends[b - 1]
            front = sa[lo:hi]
            front = front[front > 0]
            front = front[~s[front]]
            while len(front):  # runs of one character stay in their bucket
                before = front - 1
                front = before[(t[before] == t[front])]
                if len(front):
                    self._put(sa, front, t[front], free, 1)
                    front = front[front > 0]
            self._spread(sa, sa[lo:hi], free, True)
        # From above: the S suffixes, at the back; the LMS ones come anew.
        sa[place[1:]] = -1  # the first is the end of the text
        free = self.ends - 1
        for a, b in self.down:
            lo, hi = self.starts[a], self.ends[b - 1]
            back = sa[lo:hi][::-1]
            back = back[back > 0]
            back = back[s[back]]
            while len(back):
                before = back - 1
                back = before[(t[before] == t[back])]
                if len(back):
                    self._put(sa, back, t[back], free, -1)
                    back = back[back > 0]
            self._spread(sa, sa[lo:hi][::-1], free, False)
        return sa

    def _spread(self, sa: np.ndarray, batch: np.ndarray, free: np.ndarray, up: bool) -> None:
        """Put the suffixes before those of this batch into the other buckets that they belong to."""
        t = self.t
        v = batch[batch > 0]
        before = v - 1
        c = t[before]
        keep = c > t[v] if up else c < t[v]
        before, c = before[keep], c[keep]
        if not len(c):
            return
        order = _grouped(c)
        before, c = before[order], c[order]
        self._put(sa, before, c, free, 1 if up else -1)

    @staticmethod
    def _put(sa: np.ndarray, suffixes: np.ndarray, c: np.ndarray, free: np.ndarray, way: int) -> None:
        """Put suffixes into the next free places of their buckets c, which stand together."""
        if c[0] == c[-1]:
            k = len(c)
            at = free[c[0]]
            if way > 0:
                sa[at : at + k] = suffixes
            else:
                sa[at - k + 1 : at + 1] = suffixes[::-1]
            free[c[0]] += way * k
            return
        rank = _ranks(c)
        sa[free[c] + way * rank] = suffixes
        last = np.empty(len(c), bool)
        np.not_equal(c[1:], c[:-1], out=last[:-1])
        last[-1] = True
        free[c[last]] += way * (rank[last] + 1)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t: characters from 0 on without gaps, the last one 0 and there alone."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + 1
    scan = _Scan(t, s)
    if len(lms) == 1:
        return scan.induce(lms)
    sa = scan.induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    number = np.empty(n, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.r_[np.diff(lms) + 1, 1][number[ordered]]
    same = np.r_[False, length[1:] == length[:-1]]
    todo, k = np.flatnonzero(same), 0
    while len(todo):  # neighbours of one length, character by character
        equal = t[ordered[todo] + k] == t[ordered[todo - 1] + k]
        same[todo[~equal]] = False
        k += 1
        todo = todo[equal]
        todo = todo[length[todo] > k]
    names = np.cumsum(~same).astype(np.int32) - 1
    if names[-1] + 1 == len(lms):
        return scan.induce(ordered)
    reduced = np.empty(len(lms), np.int32)
    reduced[number[ordered]] = names
    return scan.induce(lms[suffix_array(reduced)])


def permuted_lcp(text: np.ndarray, sa: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order, up to about `most`.

    fresh marks positions that are compared in any case; between them values shrink by one at a time.
    """
    n = len(text)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    padded = np.zeros(n + most + 16, text.dtype)
    padded[:n] = text
    own = np.arange(n, dtype=np.int32)
    whole = fresh | (own == 0) | (phi <= 0)
    inner = ~whole
    whole[inner] = text[own[inner] - 1] != text[phi[inner] - 1]
    at = np.flatnonzero(whole & (phi >= 0))
    got = np.zeros(n, np.int64)
    x, y = at, phi[at]
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8) if text.dtype == np.uint8 else None
    packed = np.ascontiguousarray(wide).view(np.uint64).ravel() if wide is not None else None
    k = 0
    while len(x) and k < most:
        if packed is not None:
            equal = packed[x + k] == packed[y + k]
            end = ~equal
            if end.any():
                diff = (packed[x[end] + k] ^ packed[y[end] + k]).view(np.uint8).reshape(-1, 8)
                got[x[end]] = k + (diff != 0).argmax(axis=1)
            k += 8
        else:
            equal = padded[x + k] == padded[y + k]
            got[x[~equal]] = k
            k += 1
        x, y = x[equal], y[equal]
    got[x] = k
    anchor = np.maximum.accumulate(np.where(whole, own, 0))
    return np.maximum(got[anchor] - (own - anchor), 0)
