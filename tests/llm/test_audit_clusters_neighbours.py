"""Filter audit, ball k-means and the neighbours' quality votes against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import ball_kmeans, filter_audit, neighbour_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, text string"


# Filter audit


def plain_audit(rows, good, toxic):
    """rows (id, text, part): every order on every document."""
    flags = []
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        key = lambda x: math.inf if x is None else x
        copy = any((u or "") == t and key(j) < key(i) for j, u, _ in rows)
        flags.append((part or "", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), copy), i in good, i in toxic))
    out = {}
    for order in itertools.permutations(range(5)):
        for part in {f[0] for f in flags}:
            left = [f for f in flags if f[0] == part]
            for step, k in enumerate(order, 1):
                gone = [f for f in left if f[1][k]]
                rest = [f for f in left if not f[1][k]]
                every = [f for f in flags if f[0] == part and f[1][k]]
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(rest), len(gone), len(every) - len(gone), sum(sum(f[1]) == 1 for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                left = rest
    sums = Counter()
    for (part, order, step), v in out.items():
        sums[part, order[step - 1]] += v[1]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit(spark, rows, docs):
    more = [(900, "LOUD " * 80, None, "s1"), (None, "LOUD " * 80, None, "s1"), (901, "word " * 3_000_000, "aa", ""), (902, None, None, None), (903, "calm %s" % " ".join(f"w{i}" for i in range(90)), None, "only")]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars", "blob").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    good, toxic = {rows[0][0], rows[3][0], 900}, {rows[1][0], 901}
    labels = spark.createDataFrame([(i, 1, None, "x") for i in good] + [(i, None, 1, "x") for i in toxic] + [(rows[0][0], 0, 0, "x"), (None, 1, 1, "x"), (5, None, None, None)], LABELS)
    plain = [(r[0], r[1], r[3]) for r in rows] + [(r[0], r[1], r[3]) for r in more]
    assert audit_rows(filter_audit.audit(filter_audit.flagged(every, labels))) == plain_audit(plain, good, toxic)


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(filter_audit.flagged(empty, spark.createDataFrame([], LABELS))).count() == 0


# Ball k-means


def plain_kmeans(rows, k=8, rounds=10, seed=3):
    own = [(i, [min(max(math.floor(1024 * x), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in own]
        for j in range(len(c)):
            members = [v for (_, v), a in zip(own, at) if a == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *near(v)) for i, v in own]
    cost = Counter()
    for _, d, j in last:
        cost[j] += d
    return sorted(((i, j, d, cost[j], sum(cost.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, v int")


def run_kmeans(spark, rows, tmp_path):
    at = f"file://{tmp_path}"
    vectors(spark, [(i, v, 1, "x", 2) for i, v in rows]).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    out = ball_kmeans.op12_ball_kmeans(spark, at)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()), key=str)


def test_kmeans(spark, tmp_path):
    draw = random.Random(1)
    f = lambda x: float(np.float32(x))
    centres = [[draw.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    rows = [(i, [f(a + draw.gauss(0, 0.05)) for a in centres[i % 6]]) for i in range(240)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # a group of copies
    rows += [rows[3], (None, rows[7][1]), (700, None), (701, [0.5] * 63), (702, [0.5] * 65), (703, [None] + [0.1] * 63), (704, [float("nan")] * 64), (705, [math.inf] * 64), (706, []), (707, [0.0] * 64), (708, [-0.0] * 64), (709, [f(-1e-12)] * 64)]
    assert run_kmeans(spark, rows, tmp_path) == plain_kmeans(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)], [(i, [1e9] * 32 + [-1e9] * 32 if i % 2 else [-1e9] * 64) for i in range(5)], [(i, [float(i % 2)] * 64) for i in range(40)]], ids=["none", "no vector", "one", "huge", "ties"])
def test_few_vectors(spark, tmp_path, rows):
    got = run_kmeans(spark, rows, tmp_path)
    assert [r[:3] for r in got] == [r[:3] for r in plain_kmeans(rows)] and [r[5] for r in got] == [r[5] for r in plain_kmeans(rows)]
    assert [r[3:5] for r in got] == [tuple(min(x, 2**63 - 1) for x in r[3:5]) for r in plain_kmeans(rows)]


def test_rings_skip_no_neighbour():
    """From any start, the balls' rings lead to the nearest centroid, ties to the smaller number, and leave most pairs out."""
    draw = np.random.default_rng(5)
    c = draw.integers(-40, 40, (30, 4)).astype(np.int64)
    c[7] = c[3]
    x = np.concatenate([draw.integers(-40, 40, (400, 4)), c]).astype(np.int64)
    want = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    b = ball_kmeans.balls(c.tolist(), [None] * 30)
    for start in (np.zeros(len(x), np.int64), draw.integers(0, 30, len(x)), want):
        got, dist = ball_kmeans.nearest(x, start, b)
        assert (got == want).all() and (dist == ((x - c[want]) ** 2).sum(axis=1)).all()
    found, far = {}, {}
    for i in range(30):
        at = want == i
        far[i] = int(((x[at] - c[i]) ** 2).sum(axis=1).max(initial=0))
        if at.any():
            found[i] = ball_kmeans.Cluster(int(at.sum()), far[i], 0, x[at].sum(axis=0).tolist())
    moved, radii = ball_kmeans.moved(c.tolist(), found)
    for i in found:
        assert radii[i] ** 2 >= ((x[want == i] - np.array(moved[i])) ** 2).sum(axis=1).max()
    tight = ball_kmeans.balls(moved, radii)
    got, _ = ball_kmeans.nearest(x, want, tight)
    assert (got == ((x[:, None] - np.array(moved)) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(map(len, tight.near)) < 30 * 29


# Quality by neighbours


def sample_text(draw, good):
    letters = "".join(draw.choice("aeioulnrst") for _ in range(3))
    word = lambda: "".join(draw.choice("aeioulnrstdhm" + letters) for _ in range(draw.randrange(2, 9)))
    if good:
        return " ".join(word().capitalize() if draw.random() < 0.1 else word() + ("." if draw.random() < 0.1 else "") for _ in range(draw.randrange(20, 300)))
    kind = draw.randrange(3)
    return " ".join(word().upper() + "!!" if kind == 0 else word() + draw.choice(("$$$", "%%%", "&&&")) if kind == 1 else " ".join([word()] * 9) for _ in range(draw.randrange(20, 200)))


def folder(spark, tmp_path, docs, labels):
    at = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, good int, score double").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return at


def test_held_out_quality(spark, tmp_path):
    draw = random.Random(4)
    truth = {i: int(draw.random() < 0.8) for i in range(400)}
    docs = [(i, sample_text(draw, g), "aa", None, 0.0) for i, g in truth.items()] + [(1000, None, None, 1, 1.0), (1001, "", None, 1, 1.0), (None, "no id here", None, None, None), (1002, "a" * 3_000_000, None, 1, 1.0)]
    docs += [docs[5]] * 3
    labels = [(i, g, 0, "x") for i, g in truth.items()] + [(None, 0, 0, "x"), (1001, None, None, None)]
    got = neighbour_quality.op11_quality_classifier(spark, folder(spark, tmp_path, docs, labels)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((d[0] is None, d[0]) for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    own = {r.doc_id: r.score for r in got}
    assert own[1000] == own[1001] and own[1000] == pytest.approx(np.mean([g for i, g in truth.items() if zlib.crc32(str(i).encode()) % 4 != 2]))


def test_votes_like_all_pairs(spark, tmp_path):
    """Scores are those of every labelled vector against every text, one by one."""
    draw = random.Random(6)
    docs = spark.createDataFrame([(i, sample_text(draw, i % 3 > 0)) for i in range(60)], "doc_id long, text string")
    m = neighbour_quality.fit(docs, spark.createDataFrame([(i, int(i % 3 > 0), 0, "") for i in range(40)], LABELS))
    own = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in neighbour_quality.score(docs, m).collect():
        x = neighbour_quality.latent(neighbour_quality.term_counts(own[r.doc_id].encode())[None], m.basis)[0]
        sims = sorted(((float(x @ m.vectors[:, j]) / (math.sqrt(x @ x) * m.norms[j]), m.good[j]) for j in range(m.vectors.shape[1])), reverse=True)
        near = [(s, g) for s, g in sims if s >= sims[15][0] and s > 0]
        want = (sum(s**8 * g for s, g in near) + 0.5 * m.prior) / (sum(s**8 for s, _ in near) + 0.5)
        assert r.score == pytest.approx(want, rel=1e-9)


def test_pieces_count_alike(monkeypatch):
    draw = random.Random(1)
    texts = ["".join(draw.choice(["a", "b", " ", "A", "é", "!", "ab ", "ab ab ", "\n"]) for _ in range(draw.randrange(60))).encode() for _ in range(150)]
    want = [neighbour_quality.term_counts(t) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(neighbour_quality, "PIECE", size)
        assert all((neighbour_quality.term_counts(t) == w).all() for t, w in zip(texts, want, strict=True))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "")], [(77, 0, 0, "")]], ids=["none", "one", "of another table"])
def test_quality_with_few_labels(spark, tmp_path, labels):
    got = neighbour_quality.op11_quality_classifier(spark, folder(spark, tmp_path, [(1, "some words of text", None, None, None), (2, "", None, None, None)], labels)).collect()
    assert len(got) == 2 and all(r.score == (1.0 if labels and labels[0][0] == 1 else 0.5) for r in got)


def test_quality_of_nothing(spark, tmp_path):
    assert neighbour_quality.op11_quality_classifier(spark, folder(spark, tmp_path, [], [(1, 1, 0, "")])).count() == 0
