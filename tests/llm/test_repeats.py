"""Repeated strings and passages against plain versions."""

from . import brute
import numpy as np
import pytest

from panelloom.llm import repeats, suffix_dedup, window_dedup
from panelloom.llm.induced_sort import permuted_lcp, suffix_array


def _rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], set()).add(tuple(r[1:]))
    return out


def _suffix(docs, **how):
    own = repeats.keyed(docs, "doc_id", "text")
    return repeats.without(own, suffix_dedup.repeated_ranges(own, **how), suffix_dedup._digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id")


def _passages(docs):
    own = repeats.keyed(docs, "doc_id", "text")
    return repeats.without(own, window_dedup.repeated_ranges(own), window_dedup._digest, "n_words long, n_removed long, kept_sha256 string", "doc_id")


@pytest.mark.parametrize("crowd", [8000, 1])
def test_suffix_dedup(docs, rows, crowd):
    got = _suffix(docs, crowd=crowd, shard_bytes=5000)
    assert got.count() == len(rows)  # a row for each row, repeated ones too
    assert _rows(got) == {k: {v} for k, v in brute.suffix_rows({r[0]: r[1] for r in rows}).items()}


def test_passages(docs, rows):
    got = _passages(docs)
    assert got.count() == len(rows)
    assert _rows(got) == {k: {v} for k, v in brute.passage_rows({r[0]: r[1] for r in rows}).items()}


def test_edges(with_null_id, empty):
    for f in (_suffix, _passages):
        assert f(with_null_id).count() == 9
        assert f(empty).count() == 0


def test_texts_left(docs, rows):
    kept = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for k, (n, removed, _, _) in brute.suffix_rows({r[0]: r[1] for r in rows}).items():
        assert len(kept[k].kept) == n - removed and kept[k].n_removed == removed
    words = {r.doc_id: r for r in window_dedup.remove_passages(docs).collect()}
    for k, (n, removed, _) in brute.passage_rows({r[0]: r[1] for r in rows}).items():
        assert len(words[k].kept.split()) == n - removed


def test_suffix_array():
    draw = np.random.default_rng(1)
    for turn in range(400):
        n = draw.integers(1, 50)
        t = draw.integers(1, 1 + draw.integers(1, 6), n)
        if turn % 3 == 0:
            t = np.tile(t[: draw.integers(1, 5)], 20)[:n]
        t = np.r_[np.unique(t, return_inverse=True)[1] + 1, 0].astype(np.int32)
        sa, plain = suffix_array(t), t.tolist()
        order = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert sa.tolist() == order
        lcp = permuted_lcp(t.astype(np.uint8), sa, draw.random(len(t)) < 0.1, 128)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(plain) and plain[a + k] == plain[b + k]:
                k += 1
            assert lcp[b] == k
