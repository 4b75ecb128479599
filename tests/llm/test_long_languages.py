"""Texts of several pieces count as whole ones."""

import random

import numpy as np
import pytest

from panelloom.llm import language_id


def unchunked(text, bins):
    """All n-grams of the padded text at once."""
    points = [ord(c) for c in f" {text.lower()} "]
    out = []
    for n in language_id.ORDERS:
        for i in range(len(points) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for k in range(n):
                h = (h ^ points[i + k]) * int(language_id._MIX[k]) & 0xFFFFFFFF
                h ^= h >> 15
            out.append((h * 2654435761 & 0xFFFFFFFF) >> (32 - bins.bit_length() + 1))
    return np.bincount(out, minlength=bins)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64])
def test_pieces_overlap(monkeypatch, size):
    draw = random.Random(size)
    monkeypatch.setattr(language_id, "_CHUNK", size)
    for n in (1, 2, 3, 9, 10, 11, 64, 130):
        text = "".join(draw.choice("aB é日 \n😀") for _ in range(n))
        assert (np.bincount(language_id.gram_bins(text, 256), minlength=256) == unchunked(text, 256)).all()
    assert not len(language_id.gram_bins("", 256))


def test_three_million_characters(monkeypatch):
    text = "".join(random.Random(2).choices("abcdefgh ijk", k=3_000_000))
    several = np.bincount(language_id.gram_bins(text), minlength=language_id.BINS)
    monkeypatch.setattr(language_id, "_CHUNK", 1 << 23)
    assert (several == np.bincount(language_id.gram_bins(text), minlength=language_id.BINS)).all() and several.sum() == 3 * len(text) + 3


def test_long_text_is_scored(spark):
    rows = [(0, "alpha beta gamma " * 30, "xx"), (1, "uno dos tres " * 30, "yy"), (2, "alpha gamma " * 250_000, None), (3, "dos uno " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.fit(df)).collect()} == {0: "xx", 1: "yy", 2: "xx", 3: "yy"}
