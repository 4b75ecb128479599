"""Ball k-means on integer vectors, exact to the last unit.

A cluster is a ball: a centroid and a radius. Another centroid can be as near to a member as the member's own only if the
two centroids are at most twice as far apart as the member is from its own (d_ij <= 2 d, or D_ij <= 4 D in squares, which
integers decide exactly). So a ball's neighbours are the centroids within twice its radius; sorted by distance they cut the
ball into a stable core, whose members are nearer than half the way to the nearest neighbour and stay without any
comparison, and annuli: a member in the k-th annulus is compared with the k nearest neighbours only.

Vectors, each with its cluster, are a table in the shared folder, written anew each round while the one before goes; at the
end of a task come rows with the sums of its members by cluster, from which the next centroids and radii follow.
A round reads the vectors once and shuffles only these sums, so no cluster, however large, gathers anywhere. What reaches
the driver and is broadcast is k centroids of `dims` numbers and k x k distances, of a given k.

Defined cases: vectors that are null, have another length, or hold a null, NaN or infinity stay out; components are clipped to
+-2^27, so that squared distances fit a long (a sum that does not becomes the largest long); equal distances go to the
smaller number; fewer vectors than k give as many clusters as there are vectors; equal hashes (a repeated id) are ordered by
the vectors; a null id hashes like an empty one; equal vectors share a cluster, repeated rows each get their row; an empty
table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, write_table

DIMS, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
LIMIT = 1 << 27
MAX_LONG = (1 << 63) - 1
#: sums: number of members, high and low 32 bits of their summed distances, summed components.
_STATE = "id long, v binary, cluster int, distance long, far long, sums array<long>"


@dataclass(frozen=True)
class Balls:
    """Centroids, and of each its neighbours: their numbers and squared distances, nearest first."""

    centroids: np.ndarray
    near: tuple[np.ndarray, ...]
    gaps: tuple[np.ndarray, ...]


def _up(square: int) -> int:
    """The smallest integer whose square is not below this."""
    root = isqrt(square)
    return root + (root * root < square)


def balls(centroids: list[list[int]], radii: list[int | None]) -> Balls:
    """radii: an upper bound for each ball, or None where nothing is known; neighbours are within twice the radius."""
    c = np.array(centroids, np.int64)
    near, gaps = [], []
    for i, r in enumerate(radii):
        d = ((c - c[i]) ** 2).sum(axis=1)
        own = np.array([j for j in range(len(c)) if j != i and (r is None or int(d[j]) <= 4 * r * r)], np.int64)
        own = own[np.lexsort((own, d[own]))]
        near.append(own)
        gaps.append(d[own])
    return Balls(c, tuple(near), tuple(gaps))


def nearest(x: np.ndarray, own: np.ndarray, b: Balls) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance, from the clusters that the vectors are in."""
    best, dist = own.copy(), np.empty(len(x), np.int64)
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        d = ((x[at] - b.centroids[i]) ** 2).sum(axis=1)
        # 4 d may leave the range of a long where gaps don't: compare with ceil(gap / 4).
        ring = np.searchsorted(-(-b.gaps[i] // 4), d, side="right")  # 0: the stable core; k: the k-th annulus
        now, low = np.full(len(at), i), d
        for k in range(int(ring.max(initial=0))):
            j = int(b.near[i][k])
            out = np.flatnonzero(ring > k)
            e = ((x[at[out]] - b.centroids[j]) ** 2).sum(axis=1)
            wins = (e < low[out]) | ((e == low[out]) & (j < now[out]))
            now[out[wins]], low[out[wins]] = j, e[wins]
        best[at], dist[at] = now, low
    return best, dist


def integers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v): the kept vectors, as arrays of integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where((F.size("v") == dims) & F.forall("v", finite))
    return kept.select("id", F.transform("v", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e9)), F.lit(1e9)) * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")).alias("v"))


def seeds(packed: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The first centroids: vectors of the k smallest hashes of their ids."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [np.frombuffer(r["v"], "<i4").tolist() for r in packed.select("v", h.alias("h")).orderBy("h", "v").limit(k).collect()]  # k rows


def _packed(points: DataFrame) -> DataFrame:
    """The first table of vectors: all in cluster 0, without sums."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, flat = b.num_rows, b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4")
            width = flat.nbytes // n if n else 0
            raw = flat.tobytes()
            v = pa.array([raw[i * width : (i + 1) * width] for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(np.zeros(n, np.int32))], names=["id", "v", "cluster"])

    return points.mapInArrow(run, "id long, v binary, cluster int")


def assign(state: DataFrame, b: Balls) -> DataFrame:
    """The vectors with their nearest centroid, and for each task and cluster a row of its members' largest distance and sums."""
    from pyspark.sql.types import StructType

    sent = state.sparkSession.sparkContext.broadcast(b)  # k centroids and their k x k distances
    schema = StructType.fromDDL(_STATE)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out = sent.value, to_arrow_schema(schema)
        k, dims = own.centroids.shape
        far, sums = np.zeros(k, np.int64), np.zeros((k, 3 + dims), np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            x = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            c, d = nearest(x, rows.column(2).to_numpy(), own)
            for i in np.unique(c):
                at = c == i
                far[i] = max(far[i], d[at].max())
                sums[i] += [at.sum(), (d[at] >> 32).sum(), (d[at] & 0xFFFFFFFF).sum(), *x[at].sum(axis=0)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(c.astype(np.int32)), pa.array(d), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), out.field("sums").type)], schema=out)
        some = np.flatnonzero(sums[:, 0])
        if len(some):
            none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.array(far[some]), pa.array(sums[some].tolist(), out.field("sums").type)], schema=out)

    return state.select("id", "v", "cluster").mapInArrow(run, schema)


@dataclass(frozen=True)
class Cluster:
    n: int
    far: int
    cost: int
    sums: list[int]


def totals(state: DataFrame) -> dict[int, Cluster]:
    """What the tasks' rows of sums add up to, for each cluster that has members; only the narrow columns are read."""
    each = state.where("sums IS NOT NULL").select("cluster", "far", F.posexplode("sums").alias("i", "s"))
    got: dict[int, list] = {}
    for r in each.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("far").alias("far")).orderBy("cluster", "i").collect():  # k x (dims + 3) rows
        got.setdefault(r["cluster"], [r["far"]]).append(int(r["s"]))
    return {c: Cluster(n, far, (high << 32) + low, sums) for c, (far, n, high, low, *sums) in got.items()}


def moved(centroids: list[list[int]], found: dict[int, Cluster]) -> tuple[list[list[int]], list[int]]:
    """The floors of the means, and a bound for each new radius: the old one and the way that the centroid went."""
    out, radii = [], []
    for i, c in enumerate(centroids):
        f = found.get(i)
        new = c if f is None else [s // f.n for s in f.sums]
        out.append(new)
        radii.append(0 if f is None else _up(f.far) + _up(sum((a - b) ** 2 for a, b in zip(c, new, strict=True))))
    return out, radii


@dataclass(frozen=True)
class Clustering:
    """members: (id, v, cluster, distance), v as little-endian 32-bit integers; found: what each cluster adds up to."""

    members: DataFrame
    centroids: list[list[int]]
    found: dict[int, Cluster]


def ball_kmeans(points: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """points (id, v): `rounds` rounds from the seeds, and a last assignment."""
    spark = points.sparkSession
    state, path = write_table(_packed(points), "vectors")
    centroids, found = seeds(state, k, seed), {}
    if not centroids:
        return Clustering(state.withColumn("distance", F.lit(0).cast("long")), [], found)
    radii: list[int | None] = [None] * len(centroids)
    for t in range(rounds + 1):
        table, new = write_table(assign(state, balls(centroids, radii)), "members")
        discard(spark, path)
        state, path, found = table.where("sums IS NULL"), new, totals(table)
        if t < rounds:
            centroids, radii = moved(centroids, found)
    return Clustering(state.select("id", "v", "cluster", "distance"), centroids, found)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ball_kmeans(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    inertia = min(sum(f.cost for f in got.found.values()), MAX_LONG)
    facts = [(i, min(f.cost, MAX_LONG), inertia, sha256(",".join(map(str, got.centroids[i])).encode()).hexdigest()) for i, f in got.found.items()]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.members.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(each), "cluster")  # a row for each of k clusters


def _oracle() -> str:
    """Every vector against every centroid, round by round."""
    ctes = [f"p AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})"]
    ctes.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM p ORDER BY c LIMIT {K})")
    for t in range(ROUNDS + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT rid, d // 1000 AS distance, d % 1000 AS cluster FROM (SELECT rid, min(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT * 1000 + c) AS d FROM p, c{t} AS c GROUP BY rid))")
        if t < ROUNDS:
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{t} o LEFT JOIN (SELECT cluster AS c, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS v FROM (SELECT cluster, i, sum(p.v[i]) AS s, count(*) AS n FROM a{t} JOIN p USING (rid), range(1, {DIMS + 1}) AS r(i) GROUP BY cluster, i) GROUP BY cluster) n USING (c))")
    last = f"a{ROUNDS}"
    return f"WITH {', '.join(ctes)} SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {last} JOIN p USING (rid) JOIN c{ROUNDS} c ON c.c = cluster"


QUERIES = {"op12_ball_kmeans": op12_ball_kmeans}
ORACLES = {"op12_ball_kmeans": _oracle()}
