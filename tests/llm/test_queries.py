"""Every registered query of the text operators on small tables: its columns, one row for each document, and what its digests say."""

import hashlib
import random
import zlib

import pytest

from panelloom.llm import ngram_lm, queries

from . import brute

COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_mix_sources": "doc_id size source_size target taken",
    "op5_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op6_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_simhash_neardup": "doc_id fingerprint component_id",
    "op10_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, folder, rows, name):
    df = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    out = df.collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    own = {r.doc_id: r for r in out}
    texts = {r[0]: r[1] for r in rows}
    if name == "op9_simhash_neardup":
        assert all(own[i].fingerprint == f"{brute.fingerprint(t):016x}" for i, t in texts.items())
    if name == "op1_suffix_dedup":
        want = brute.suffix_rows(texts)
        assert all(tuple(own[i])[1:5] == want[i] for i in texts)
    if name == "op6_document_fingerprints":
        assert all(own[i].n_chars == len(t or "") for i, t in texts.items())
    if name in ("op7_language_id", "op10_lm_scoring"):
        n = 4 if name == "op7_language_id" else 7
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % n == 2) for i, r in own.items())
    if name == "op5_substring_dedup":
        assert own[[i for i, t in texts.items() if t is None][0]].kept_sha256 == hashlib.sha256(b"").hexdigest()


def _votes(text: str) -> list[float]:
    """Votes on each of 128 bits, in whole numbers and one term after the other."""
    import math

    import xxhash

    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def runs(numbers, n, salt):
        out: dict = {}
        for k in range(len(numbers) - n + 1):
            h = 0
            for x in numbers[k : k + n]:
                h = mix(h + x + salt & top)
            out[h] = out.get(h, 0) + 1
        return out

    words = [xxhash.xxh64_intdigest(w, ngram_lm.SEED) for w in text.encode().lower().split()]
    votes = [0.0] * 128
    if not words:
        return votes
    fade = max(0.0, 1 - (len(words) - 1) / 64)
    for terms, weight in ((runs(words, min(3, len(words)), 0), 1.0), (runs([ord(c) for c in text.lower()], 4, 1 << 40), fade)):
        for h, n in terms.items():
            both = h | mix(h + 0x5851F42D4C957F2D & top) << 64
            for i in range(128):
                votes[i] += weight * (1 + math.log(n)) * (1 if both >> i & 1 else -1)
    return votes


def test_fingerprint_votes(spark, folder, rows):
    """The weighted vote, bit by bit, of texts and edited texts, and likeness as the share of bits that agree."""
    from panelloom.llm import fingerprints

    got = {r.doc_id: r for r in fingerprints.op6_document_fingerprints(spark, folder).collect()}
    bits = lambda digest: int.from_bytes(bytes.fromhex(digest), "little")
    agree = lambda a, b: 1 - bin(bits(a) ^ bits(b)).count("1") / 128
    order = sorted({r[0]: r[1] or "" for r in rows}.items(), reverse=True)
    twice = {r[0] for r in rows if [x[0] for x in rows].count(r[0]) > 1}
    for k, (doc, text) in enumerate(order):
        next_id, following = order[(k + 1) % len(order)]
        if len(text) > 6000 or doc in twice:
            continue
        for said, of in ((got[doc].fingerprint, text), (got[doc].edited_fingerprint, fingerprints.edit(text, following))):
            assert all(abs(v) < 1e-3 or (v > 0) == bool(bits(said) >> i & 1) for i, v in enumerate(_votes(of)))
        assert got[doc].near_edited == agree(got[doc].fingerprint, got[doc].edited_fingerprint)
        assert got[doc].near_next == agree(got[doc].fingerprint, got[next_id].fingerprint)
    # The search, against all pairs.
    for r in rows:
        mine, said = got[r[0]], [(bin(bits(got[r[0]].fingerprint) ^ bits(got[x[0]].fingerprint)).count("1"), x[0]) for x in rows]
        if r[0] % 100 or r[0] in twice:
            assert r[0] % 100 == 0 or (mine.n_within, mine.near_id, mine.near_bits) == (None, None, None)
            continue
        near = min(((d, i) for d, i in said if d <= fingerprints.RADIUS and i != r[0]), default=(None, None))
        twins = sorted(i for d, i in said if d == 0)
        if len(twins) > 1:
            near = 0, twins[0] if r[0] > twins[0] else twins[-1]
        assert mine.n_within == sum(d <= fingerprints.RADIUS for d, _ in said) and (mine.near_bits, mine.near_id) == near


def test_no_length_parts_neighbours():
    """A text with one word more stays alike, whatever its length."""
    from panelloom.llm import fingerprints

    draw, maker = random.Random(2), fingerprints.SimHash()
    words = [["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9))) for _ in range(101)] for _ in range(20)]
    mean = {n: sum(fingerprints.likeness(maker.of(" ".join(w[:n])), maker.of(" ".join(w[: n + 1]))) for w in words) / len(words) for n in range(10, 100)}
    assert min(mean.values()) > 0.85
    assert max(abs(mean[n] - mean[n + 1]) for n in range(10, 99)) < 0.04


def test_search_names_the_nearest(spark):
    from pyspark.sql import functions as F

    from panelloom.llm import fingerprints

    rows = spark.createDataFrame([(100, 7, 0), (3, 7, 0), (5, 7, 0), (200, 1 << 40, 1), (9, (1 << 40) + 1, 1), (300, -1, -1), (400, 0xF0F0F0, 1 << 50), (None, 0xF0F0F0, 1 << 50), (0, 0xFF << 40, 0xFF)], "doc_id long, lo long, hi long")
    got = {r.doc_id: (r.n_within, r.near_id, r.near_bits) for r in fingerprints.search(rows, F.col("doc_id") % 100 == 0, radius=2).collect()}
    assert got == {100: (3, 3, 0), 3: (None,) * 3, 5: (None,) * 3, 200: (2, 9, 1), 9: (None,) * 3, 300: (1, None, None), 400: (2, None, None), None: (None,) * 3, 0: (1, None, None)}
