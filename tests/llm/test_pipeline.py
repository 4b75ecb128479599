"""The pipeline's stages, each against a plain account of what it should keep."""

import random

import corpus_pipeline
import pytest

from panelloom.llm import shingle_neardup


def test_stages(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/stage{k}")
            now = spark.read.parquet(f"{folder}/stage{k}")
            sizes.append(now.count())
    assert 0 < sizes[1] < sizes[0] < len(rows) and sizes[2] == sizes[1]
    assert out.count() == sizes[3]
    assert corpus_pipeline.run(spark, folder).count() == sizes[3]


def _jaccard(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_from_four_fifths(spark):
    """Copies with scattered changes go from a five-word similarity of 0.8 on; those below stay."""
    draw = random.Random(8)
    rows, want = [], set()
    for k in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for i in range(7, 300, 300 // (6 if k % 2 else 16)):
            other[i] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} | ({2 * k + 1} if _jaccard(words, other) < 0.8 else set())
        assert (0.8 <= _jaccard(words, other) < 0.85) if k % 2 else (_jaccard(words, other) < 0.65)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


@pytest.mark.parametrize("limit", [32, 3])
def test_large_groups_stay_whole(spark, limit):
    draw = random.Random(9)
    base = [f"w{draw.randrange(5000)}" for _ in range(200)]
    rows = [(k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(100)] + [(100 + k, " ".join(draw.choices(base, k=60))) for k in range(20)]
    got = shingle_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    assert {r.doc_id: r.component for r in got} == {k: 0 if k < 100 else k for k in range(120)}


@pytest.mark.parametrize("limit", [2, 1000])
def test_group_of_edited_copies(spark, limit):
    """Copies of one text with more or fewer edits each, some alike and some not: classes as of all pairs, at either side of the limit."""
    draw = random.Random(10)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    texts = []
    for k in range(120):
        words = list(base[: 150 - k % 30])
        for i in draw.sample(range(len(words)), draw.choice([1, 2, 2, 3, 3, 4])):
            words[i] = f"x{k}.{i}"
        texts.append(words)
    class_of = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if _jaccard(texts[i], texts[j]) >= 0.8 and class_of[i] != class_of[j]:
                old, new = max(class_of[i], class_of[j]), min(class_of[i], class_of[j])
                class_of = [new if c == old else c for c in class_of]
    assert 1 < len(set(class_of)) < len(texts)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = shingle_neardup.near_duplicates(docs, limit=limit).collect()
    assert {r.doc_id: r.component for r in got} == dict(enumerate(class_of))


def test_odd_columns_and_rows(spark, docs, rows):
    """Column names that stages use themselves, dots, null and repeated ids with other texts, and a long text."""
    from pyspark.sql import functions as F

    from panelloom.llm import covering_lsh, mixing, pii_labels

    long = " ".join(f"word{k}" for k in range(300_000))  # over 2 MB
    more = spark.createDataFrame([(None, long), (None, "null id " * 30), (1000, "one id " * 30 + "a"), (1000, "quite another text of the same id"), (1000, None)], "doc_id long, text string")
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more, allowMissingColumns=True)
    odd = odd.withColumns({c: F.lit(k) for k, c in enumerate(("m_takes", "m_size", "m_take", "m_draws", "row", "a.b", "k_text", "own_id", "key", "bucket", "fp"))})
    kept = covering_lsh.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1000 AND length(text) > 0").count() == 2
    assert kept.where("doc_id IS NULL").count() == 2 and shingle_neardup.keep_one(odd).columns == odd.columns
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("`a.b` = 5 AND m_take = 2 AND row = 4").count() == mixed.count() > 0
    clean = pii_labels.redact_documents(odd, pii_labels.fit(odd))
    assert clean.columns == odd.columns and clean.where("`a.b` = 5").count() == odd.count()


def test_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
