"""Block bootstrap and loss cascades with random numbers counted from (seed, path, ...), so that any engine and
any partitioning draw the same ones."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .metrics import rank_metrics
from .network import latest_edges_of
from .quantiles import percentiles
from .scan import Ordered, framed, numbered
from .timeindex import rolling_sum

PRIME = 2147483647  # products stay far below 2^63
SEED = 20260717


def draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to PRIME - 1: a multiplicative congruential hash of whole numbers."""
    x = F.lit(seed).cast("long")
    for p in parts:
        x = ((x * 48271 + p.cast("long") * 7919 + 12345) % PRIME * 69621 + 1) % PRIME
    return x * 48271 % PRIME


def unit(seed: int, *parts: Column) -> Column:
    return draw(seed, *parts) / F.lit(float(PRIME))


def _blocks(spark: SparkSession, n: int, reps: int, block: int, seed: int) -> DataFrame:
    """(rep, start, size): the blocks of each replication of n rows; the last one is cut so that sizes add up to n."""
    if not n:
        return spark.createDataFrame([], "rep long, start long, size long")
    b = min(block, n)
    slots = -(-n // b)
    slot = F.col("id") % slots
    at = spark.range(reps * slots).select((F.expr(f"id div {slots}") + 1).alias("rep"), slot.alias("slot"))
    return at.select("rep", (draw(seed, F.col("rep"), F.col("slot")) % (n - b + 1)).alias("start"), F.least(F.lit(b), n - F.col("slot") * b).cast("long").alias("size"))


def bootstrap_samples(rows: DataFrame, reps: int, block: int = 14, seed: int = SEED + 901) -> DataFrame:
    """rows (period, label, score) resampled in moving blocks: (rep, label, score), as many in each rep as rows."""
    r = staged(numbered(rows, ["period"], "i", 0).select("i", "label", "score"), "rows")
    picks = _blocks(rows.sparkSession, r.count(), reps, block, seed).select("rep", F.explode(F.expr("sequence(start, start + size - 1)")).alias("i"))
    return picks.join(r, "i").select("rep", "label", "score")


#: Rows in order that one task counts the blocks of, rows with counts in one range of scores, and rows whose counts are unpacked at once.
PIECE = 4096
RANGE = 1 << 16
CHUNK = 1024


def _packed(w: np.ndarray) -> list[bytes]:
    """Rows of counts, a byte each where that holds all of a row."""
    small = w.max(axis=1) < 256
    return [(x.astype(np.uint8) if s else x.astype(np.uint32)).tobytes() for x, s in zip(w, small, strict=True)]


def _unpacked(rows: list[bytes], reps: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8 if len(x) == reps else np.uint32) for x in rows]).astype(np.int64)


def multiplicities(rows: DataFrame, reps: int, block: int = 14, seed: int = SEED + 901, piece: int = PIECE) -> DataFrame:
    """(score, label, times) of rows (period, label, score): times holds, for each replication, how often it has them.

    A piece of rows that follow each other meets the blocks that reach into it and counts them by running sums of
    starts and ends; its rows of one score and label become one. A null label counts as 0, a null score as the lowest.
    """
    label, score = F.coalesce(F.col("label").cast("int"), F.lit(0)), F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))
    r = staged(numbered(rows, ["period"], "i", 0).select("i", label.alias("label"), score.alias("score")), "rows")
    n = r.count()
    reach = F.explode(F.expr(f"sequence(start div {piece}, (start + size - 1) div {piece})"))
    blocks = _blocks(rows.sparkSession, n, reps, block, seed).withColumn("piece", reach)

    def count(key, own, met):
        import pandas as pd

        low = int(key[0]) * piece
        long = min(piece, n - low)
        steps = np.zeros((long + 1, reps), np.int32)
        start, rep = met["start"].to_numpy() - low, met["rep"].to_numpy() - 1
        np.add.at(steps, (np.maximum(start, 0), rep), 1)
        np.add.at(steps, (np.minimum(start + met["size"].to_numpy(), long), rep), -1)
        times = np.cumsum(steps[:long], axis=0)[own["i"].to_numpy() - low]
        groups = own.groupby(["score", "label"], dropna=False, sort=False)
        each = groups.ngroup().to_numpy()
        total = np.zeros((groups.ngroups, reps), np.int32)
        np.add.at(total, each, times)
        first = own.iloc[np.unique(each, return_index=True)[1]]
        return pd.DataFrame({"score": first["score"].to_numpy(), "label": first["label"].to_numpy(), "times": _packed(total)})

    own = r.withColumn("piece", F.expr(f"i div {piece}"))
    out = own.groupBy("piece").cogroup(blocks.groupBy("piece")).applyInPandas(count, "score double, label int, times binary")
    return out.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas gives NaN back as null


def _by_part(batches, reps: int):
    """(part, carried counts or None, scores, labels, times) in chunks, from batches ordered by part."""
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            part, kind, score, label, times = (c.to_pylist() for c in b.slice(lo, CHUNK).columns)
            cuts = [0, *[k for k in range(1, len(part)) if (part[k], kind[k]) != (part[k - 1], kind[k - 1])], len(part)]
            for x, y in zip(cuts, cuts[1:]):
                if kind[x] == 0:
                    yield part[x], np.frombuffer(times[x], np.int64).reshape(2, reps), None, None, None
                else:
                    yield part[x], None, np.array(score[x:y]), np.array(label[x:y], np.int64), _unpacked(times[x:y], reps)


def resampled_precision(rows: DataFrame, reps: int, block: int = 14, seed: int = SEED + 901, piece: int = PIECE, span: int = RANGE) -> DataFrame:
    """(rep, average_precision) of the replications, null without events, in one pass over the scores in order.

    Rows go with their counts to ranges of descending scores. Each range's sums, and so what all replications have above
    it, are carried into it as its first row; a task then streams through its ranges, whose size is not bounded by
    memory, and adds every score's share of all replications at once. Rows of replications are never made.
    """
    counted = staged(multiplicities(rows, reps, block, seed, piece), "counted")
    parts = max(1, -(-counted.count() // span))
    dealt = counted.repartitionByRange(parts, F.desc("score")) if parts > 1 else counted.coalesce(1)
    # Written, as the edges of ranges come from a sample and must not move between the passes.
    dealt = staged(dealt.select(F.spark_partition_id().alias("part"), F.lit(1).alias("kind"), "score", "label", "times"), "ranges")
    fields = "part int, kind int, score double, label int, times binary"

    def total(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for part, _, _, label, times in _by_part(batches, reps):
            s = sums.setdefault(part, np.zeros((2, reps), np.int64))
            s += np.stack([label @ times, times.sum(axis=0)])
        for part, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s[0].tolist()], pa.list_(pa.int64())), pa.array([s[1].tolist()], pa.list_(pa.int64()))], ["part", "events", "all"])

    if parts > 1:
        each = dealt.mapInArrow(total, "part int, events array<long>, all array<long>").select("part", F.posexplode(F.arrays_zip("events", "all")).alias("rep", "s"))
        each = each.groupBy("rep", "part").agg(F.sum("s.events").alias("events"), F.sum("s.all").alias("all"))
        above = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        each = each.select("rep", "part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("events", "all")])
        lists = each.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("rep", "events", "all"))).alias("x"))  # reps entries

        def pack(batches):
            import pyarrow as pa

            for b in batches:
                packed = [np.array([[r[c] for r in x] for c in ("events", "all")], np.int64).tobytes() for x in b.column(1).to_pylist()]
                none = pa.nulls(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int32()), none.cast(pa.float64()), none.cast(pa.int32()), pa.array(packed, pa.binary())], ["part", "kind", "score", "label", "times"])

        dealt = dealt.unionByName(lists.mapInArrow(pack, fields)).repartition(parts, "part")
    ordered = dealt.sortWithinPartitions("part", "kind", F.desc("score"))

    def stream(batches):
        import pyarrow as pa

        def closed(part):
            arrays = [pa.array(range(1, reps + 1), pa.int64()), pa.array(share + _share(tie, above)), pa.array(found + tie[0])]
            return pa.RecordBatch.from_arrays(arrays, ["rep", "share", "events"])

        now = None
        for part, carried, score, label, times in _by_part(batches, reps):
            if part != now:
                if now is not None:
                    yield closed(now)
                now, last = part, None
                above, tie = np.zeros((2, reps), np.int64), np.zeros((2, reps), np.int64)
                share, found = np.zeros(reps), np.zeros(reps, np.int64)
            if carried is not None:
                above = carried.copy()
                continue
            same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            sums = np.stack([np.add.reduceat(times * label[:, None], first), np.add.reduceat(times, first)])
            if last is not None and (score[0] == last or (np.isnan(score[0]) and np.isnan(last))):
                sums[:, 0] += tie
            elif last is not None:
                share, found, above = share + _share(tie, above), found + tie[0], above + tie
            upto = above[:, None] + np.cumsum(sums[:, :-1], axis=1)
            if upto.shape[1]:
                share = share + (sums[0, :-1] * upto[0] / np.maximum(upto[1], 1)).sum(axis=0)
                found, above = found + sums[0, :-1].sum(axis=0), upto[:, -1]
            tie, last = sums[:, -1], score[-1]  # open, as more rows of this score may follow
        if now is not None:
            yield closed(now)

    each = ordered.mapInArrow(stream, "rep long, share double, events long").groupBy("rep").agg(F.sum("share").alias("share"), F.sum("events").alias("events"))
    return each.select("rep", F.try_divide("share", F.when(F.col("events") > 0, F.col("events"))).alias("average_precision"))


def _share(tie: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What one score adds: its events times the precision at it."""
    upto = above + tie
    return tie[0] * upto[0] / np.maximum(upto[1], 1)


def block_bootstrap(rows: DataFrame, reps: int = 1000, block: int = 14, seed: int = SEED + 901) -> DataFrame:
    """Average precision and its 95 % interval; replicates without an event are left out and counted."""
    each = resampled_precision(rows, reps, block, seed)
    q = F.percentile("average_precision", F.array(F.lit(0.025), F.lit(0.975)))
    out = each.agg(q.alias("q"), F.count("average_precision").alias("replications"), F.count_if(F.col("average_precision").isNull()).alias("without_events"))
    point = rank_metrics(rows.withColumn("all", F.lit(1)), ["all"]).select(F.col("average_precision").alias("point_estimate"))
    return point.crossJoin(out).select("point_estimate", F.col("q")[0].alias("ci_lower_95"), F.col("q")[1].alias("ci_upper_95"), "replications", "without_events")  # one row each


def seven_day_losses(cells: DataFrame, value: str = "ret", days: int = 7) -> DataFrame:
    """(entity, period, loss): loss over the last `days` rows, null unless all are there."""
    return cells.select("entity", "period", "n", value).withColumn("loss", 1.0 - F.exp(rolling_sum(value, days, partition=("entity",)))).select("entity", "period", "loss")


def loss_tails(losses: DataFrame, cutoff: float, cap: float) -> DataFrame:
    """(entity, k, size, loss): positive losses, capped, from each entity's cutoff quantile up; numbered from 0."""
    return all_tails(losses, [(cutoff, cap)]).select("entity", "k", "size", "loss")


def all_tails(losses: DataFrame, kinds: list[tuple[float, float]]) -> DataFrame:
    """(entity, tail, cap, k, size, loss): loss_tails for several (cutoff, cap), in one pass over the losses."""
    kind = F.explode(F.array(*[F.struct(F.lit(t).alias("tail"), F.lit(c).alias("cap")) for t, c in kinds]))
    p = losses.where("loss > 0").withColumn("kind", kind).select("entity", "period", "kind.*", F.least("loss", "kind.cap").alias("loss"))
    cutoffs = sorted({t for t, _ in kinds})
    at = F.array_position(F.array(*[F.lit(t) for t in cutoffs]), F.col("tail")).cast("int")
    keys = ["entity", "tail", "cap"]
    low = percentiles(p, keys, ("loss",), cutoffs).select(*keys, F.element_at("q", at).alias("low"))
    tail = p.join(low, keys).where("loss >= low")
    by = Window.partitionBy(*keys)
    return tail.select(*keys, (F.row_number().over(by.orderBy("loss", "period")) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(by).alias("size"), "loss")


def weights(cells: DataFrame, kind: str) -> DataFrame:
    """(entity, w, below): shares of the last known values, or equal ones, and the sum of the shares before."""
    if kind == "equal":
        w = cells.groupBy("entity").agg(F.lit(1.0).alias("v"))
    else:
        w = cells.groupBy("entity").agg(F.coalesce(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0.0)).alias("v"))
    one = w.crossJoin(F.broadcast(w.agg(F.sum("v").alias("_all")))).select("entity", (F.col("v") / F.col("_all")).alias("w"))  # one row
    return Ordered.of(one, ["entity"]).sums({"_upto": F.col("w")}).result().select("entity", "w", (F.col("_upto") - F.col("w")).alias("below"))


SCENARIO = "scenario string, multiplier double, rounds int, threshold double, tail double, cap double, window int, weighting string, paths long"


def scenario_rows(grid_paths: int = 3000, base_paths: int = 5000) -> list[tuple]:
    """The baseline, all combinations of six parameters, and the baseline with equal weights."""
    # The parameters of the baseline and of the grid.
    out = [("baseline", 0.50, 2, 0.45, 0.85, 0.50, 60, "value", base_paths)]
    grid = product((0.30, 0.70), (1, 3), (0.30, 0.60), (0.80, 0.90), (0.30, 0.50), (30, 90))
    out += [(f"grid_{k:02d}", *g, "value", grid_paths) for k, g in enumerate(grid, 1)]
    return [*out, ("baseline_equal", 0.50, 2, 0.45, 0.85, 0.50, 60, "equal", base_paths)]


def _incoming(ents: DataFrame, edges: DataFrame) -> DataFrame:
    """(window, threshold, incoming): for each entity, in order of its number, its edges as structs (src, rho) by number."""
    number = lambda c: ents.select(F.col("entity").alias(c), F.col("e").alias(f"{c}_e"))
    known = edges.join(number("src"), "src").join(number("dst"), "dst").withColumn("rho", F.greatest("rho", F.lit(0.0))).where("rho > 0")
    every = edges.select("window", "threshold").distinct().crossJoin(ents.select(F.col("e").alias("dst_e")))  # few kinds x entities
    each = known.groupBy("window", "threshold", "dst_e").agg(F.sort_array(F.collect_list(F.struct(F.col("src_e").alias("src"), "rho"))).alias("from"))
    each = every.join(each, ["window", "threshold", "dst_e"], "left")
    none = F.array().cast("array<struct<src:int,rho:double>>")
    rows = F.sort_array(F.collect_list(F.struct("dst_e", F.coalesce("from", none).alias("from"))))
    return each.groupBy("window", "threshold").agg(F.transform(rows, lambda x: x["from"]).alias("incoming"))


def _struck(r: int, seed: int, jitter: bool) -> Column:
    """The shock of each entity that round r of a path (sid, path, hit, front, incoming, line, ...) hits, null for the others."""
    size = F.size("line").cast("long")

    def passed(x: Column, d: Column) -> Column:
        factor = F.lit(0.75) + 0.5 * unit(seed, F.col("sid"), F.col("path"), F.lit(r + 1), x["src"].cast("long") * size + d) if jitter else F.lit(1.0)
        v = F.get("front", x["src"]) * F.col("multiplier") * x["rho"] * factor
        return F.when(v.isNotNull(), F.ln(1.0 - F.least(v, F.col("cap")))).otherwise(F.lit(0.0))

    def struck(source: Column, d: Column) -> Column:
        left = F.aggregate(source, F.lit(0.0), lambda a, x: a + passed(x, d))
        return F.when(F.get("hit", d).isNull() & (left < 0), F.least(1.0 - F.exp(left), F.col("cap")))

    return F.when(F.col("rounds") >= r, F.transform("incoming", struck)).otherwise(F.transform("line", lambda x: F.lit(None).cast("double")))


#: Entities, and rows of loss tails, up to which a path is a row with arrays of all entities (a graph of at most WHOLE squared edges is broadcast).
WHOLE, WHOLE_TAILS = 400, 1_000_000


def cascade(cells: DataFrame, scenarios: list[tuple], seed: int = SEED, losses: DataFrame | None = None, edges: DataFrame | None = None, jitter: bool = True, whole: int = WHOLE) -> DataFrame:
    """One row for each scenario: mean, 95th and 99th percentile of the weighted loss, P(loss > 10 %), mean number hit.

    An entity is drawn by weight and a shock from its tail; in each round the entities hit last pass it on along edges
    to those not hit yet, and several shocks combine to 1 - prod(1 - v). Shocks are capped; an entity is hit once.
    Counts decide how: a small graph comes along with each path as arrays (_in_rows), a larger one stays a table of edges
    that the last round's hits are joined with (_by_edges). If a path draws an entity without a tail, the query fails.
    """
    spark: SparkSession = cells.sparkSession
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(scenarios)], "sid int, " + SCENARIO)
    losses = seven_day_losses(cells) if losses is None else losses
    edges = latest_edges_of(cells, "ret", sorted({(s[6], s[3]) for s in scenarios})) if edges is None else edges
    ents = staged(numbered(cells.select("entity").distinct(), ["entity"], "e", 0).withColumn("e", F.col("e").cast("int")), "entities")
    tails = staged(all_tails(losses, sorted({(s[4], s[5]) for s in scenarios})).join(ents, "entity"), "tails")
    size, kinds = ents.count(), sorted({s[7] for s in scenarios})  # counts come from the files' footers
    shares = staged(reduce(DataFrame.unionByName, [weights(cells, k).join(ents, "entity").withColumn("weighting", F.lit(k)) for k in kinds]), "weights")
    rounds = max(s[2] for s in scenarios)
    # The paths are dealt over all tasks.
    paths = table.select("sid", F.explode(F.expr("sequence(1L, paths)")).alias("path")).repartition(spark.sparkContext.defaultParallelism * 2, "sid", "path")
    few = size <= whole and tails.count() <= WHOLE_TAILS
    per = (_in_rows if few else _by_edges)(table, paths, ents, edges, tails, shares, rounds, size, seed, jitter)
    q = F.percentile("loss", F.array(F.lit(0.95), F.lit(0.99)))
    got = per.groupBy("sid").agg(F.avg("loss").alias("mean_loss"), q.alias("q"), F.avg((F.col("loss") > 0.10).cast("double")).alias("probability_over_10pct"), F.avg("hit").alias("mean_hit"))
    return table.join(got, "sid").select("scenario", "multiplier", "rounds", "threshold", "tail", "cap", "window", "weighting", "paths", "mean_loss", F.col("q")[0].alias("p95_loss"), F.col("q")[1].alias("p99_loss"), "probability_over_10pct", "mean_hit")


def _no_tail(missing: Column, value: Column) -> Column:
    return F.when(missing, F.raise_error(F.lit("a path draws an entity without a loss tail"))).otherwise(value)


def _in_rows(table: DataFrame, paths: DataFrame, ents: DataFrame, edges: DataFrame, tails: DataFrame, shares: DataFrame, rounds: int, size: int, seed: int, jitter: bool) -> DataFrame:
    """(sid, path, loss, hit) where a path is a row that holds a shock for each entity: rounds run in place, without a shuffle."""
    lines = shares.groupBy("weighting").agg(F.sort_array(F.collect_list(F.struct("e", "w", "below"))).alias("line"))
    tails = tails.groupBy("e", "tail", "cap").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "loss"))), lambda x: x["loss"]).alias("losses"))
    facts = table.join(lines, "weighting").join(_incoming(ents, edges), ["window", "threshold"], "left")
    facts = facts.withColumn("incoming", F.coalesce("incoming", F.transform("line", lambda x: F.array().cast("array<struct<src:int,rho:double>>"))))
    paths = paths.join(F.broadcast(facts), "sid").withColumn("u", unit(seed, F.col("sid"), F.col("path"), F.lit(0)))  # a row for each scenario, of at most WHOLE entities
    # The last entity whose interval begins at or below the number: the last interval is open.
    drawn = F.element_at(F.filter("line", lambda x: (x["w"] > 0) & (x["below"] <= F.col("u"))), -1)["e"]
    paths = paths.withColumn("e", drawn).join(F.broadcast(tails), ["e", "tail", "cap"], "left")  # at most WHOLE_TAILS losses
    k = draw(seed, F.col("sid"), F.col("path"), F.lit(1)) % F.size("losses")
    paths = paths.withColumn("shock", _no_tail(F.col("losses").isNull(), F.least(F.get("losses", k.cast("int")), F.col("cap"))))
    paths = paths.withColumn("hit", F.transform("line", lambda x: F.when(x["e"] == F.col("e"), F.col("shock")))).withColumn("front", F.col("hit"))
    for r in range(1, rounds + 1):
        paths = paths.withColumn("front", _struck(r, seed, jitter)).withColumn("hit", F.zip_with("hit", "front", lambda a, b: F.coalesce(a, b)))
    loss = F.aggregate(F.zip_with("line", "hit", lambda x, h: x["w"] * F.coalesce(h, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return paths.select("sid", "path", loss.alias("loss"), F.size(F.filter("hit", lambda h: h > 0)).alias("hit"))


def _by_edges(table: DataFrame, paths: DataFrame, ents: DataFrame, edges: DataFrame, tails: DataFrame, shares: DataFrame, rounds: int, size: int, seed: int, jitter: bool) -> DataFrame:
    """(sid, path, loss, hit) where an entity hit is a row: each round joins the last hits with the edges and leaves out who was hit before."""
    number = lambda c: ents.select(F.col("entity").alias(c), F.col("e").alias(f"{c}_e"))
    links = edges.where("rho > 0").join(number("src"), "src").join(number("dst"), "dst").select("window", "threshold", F.col("src_e").alias("e"), F.col("dst_e").alias("dst"), "rho")
    links = staged(links, "links")
    own = "sid path multiplier rounds cap window threshold".split()
    paths = paths.join(F.broadcast(table), "sid").withColumn("u", unit(seed, F.col("sid"), F.col("path"), F.lit(0)))  # a row for each scenario
    # As many bins of [0, 1) as entities: an entity stands in each bin that its interval meets, a path in one.
    bin_of = lambda c: F.least(F.greatest(F.floor(c * size), F.lit(0)), F.lit(size - 1))
    lasts = shares.where("w > 0").groupBy("weighting").agg(F.max("e").alias("last"))
    some = shares.where("w > 0").join(F.broadcast(lasts), "weighting")  # a row for each weighting
    end = F.when(F.col("e") == F.col("last"), F.lit(1.0)).otherwise(F.col("below") + F.col("w"))
    cover = some.select("weighting", "e", "below", F.explode(F.sequence(bin_of(F.col("below")), bin_of(end))).alias("bin"))
    met = paths.withColumn("bin", bin_of(F.col("u"))).join(cover, ["weighting", "bin"]).where("below <= u")
    drawn = met.groupBy(*own, "tail", "weighting").agg(F.max("e").alias("e"))
    sizes = tails.select("e", "tail", "cap", "size").distinct()
    drawn = drawn.join(sizes, ["e", "tail", "cap"], "left").withColumn("k", _no_tail(F.col("size").isNull(), draw(seed, F.col("sid"), F.col("path"), F.lit(1)) % F.col("size")))
    front = drawn.join(tails.select("e", "tail", "cap", "k", "loss"), ["e", "tail", "cap", "k"]).select(*own, "e", F.least("loss", "cap").alias("shock"))
    front = staged(front, "front")
    hit = front.select("sid", "path", "e", "shock")
    for r in range(1, rounds + 1):
        factor = F.lit(0.75) + 0.5 * unit(seed, F.col("sid"), F.col("path"), F.lit(r + 1), F.col("e").cast("long") * size + F.col("dst")) if jitter else F.lit(1.0)
        v = F.least(F.col("shock") * F.col("multiplier") * F.col("rho") * factor, F.col("cap"))
        passed = front.where(F.col("rounds") >= r).join(links, ["window", "threshold", "e"]).withColumn("v", v).drop("e").withColumnRenamed("dst", "e").where("v > 0")
        passed = passed.join(hit.select("sid", "path", "e"), ["sid", "path", "e"], "left_anti")
        front = staged(passed.groupBy(*own, "e").agg(F.sum(F.ln(1.0 - F.col("v"))).alias("left")).select(*own, "e", F.least(1.0 - F.exp("left"), "cap").alias("shock")), "front")
        hit = hit.unionByName(front.select("sid", "path", "e", "shock"))
    each = hit.join(F.broadcast(table.select("sid", "weighting")), "sid").join(shares.select("weighting", "e", "w"), ["weighting", "e"])  # a row for each scenario
    return each.groupBy("sid", "path").agg(F.sum(F.col("w") * F.col("shock")).alias("loss"), F.count_if(F.col("shock") > 0).alias("hit"))


def historical_tail(cells: DataFrame, days: int = 7) -> DataFrame:
    """Quantiles of the equal-weight basket's losses, and the median number of entities that lose over 1 % in its tail."""
    basket = framed(cells.groupBy("period", "n").agg(F.avg("ret").alias("r")), ["n"], days - 1, 0, lambda _: {"loss": 1.0 - F.exp(rolling_sum("r", days, order="_i", partition=("_part",)))}).select("period", "loss")
    q = basket.agg(F.percentile("loss", F.array(F.lit(0.95), F.lit(0.99))).alias("q"), F.max("loss").alias("top"))
    tail = basket.crossJoin(F.broadcast(q)).where(F.col("loss") >= F.col("q")[0]).select("period")  # one row
    n = seven_day_losses(cells, days=days).join(tail, "period").groupBy("period").agg(F.count_if(F.col("loss") > 0.01).alias("k")).agg(F.median("k").alias("k"))
    each = F.array(*[F.struct(F.lit(a).alias("quantity"), b.cast("double").alias("value")) for a, b in (("loss_p95", F.col("q")[0]), ("loss_p99", F.col("q")[1]), ("loss_max", F.col("top")), ("median_entities_in_tail", F.col("k")))])
    return q.crossJoin(n).select(F.explode(each).alias("e")).select("e.*")  # one row each


ASSUMPTIONS = [
    ("initial shock", "one entity, drawn by weight; size drawn from its own upper tail of seven-day losses"),
    ("tail", "positive losses from the cutoff quantile up, capped"),
    ("edges", "pair correlations of the last rows at or above the threshold, in both directions"),
    ("propagation", "shock times multiplier times positive correlation times a uniform factor from 0.75 to 1.25"),
    ("combination", "several shocks to one entity combine to one minus the product of what each leaves"),
    ("cap", "no shock is larger than the cap"),
    ("rounds", "an entity passes its shock on once, in the round after it is hit"),
    ("weights", "shares of the last known values, or equal shares"),
    ("randomness", "numbers are counted from seed, scenario, path, round and edge"),
    ("use", "a stress comparison of parameters, not a forecast"),
]


def assumptions(cells: DataFrame) -> DataFrame:
    """What the scenarios assume, beside the extent of the panel that they are drawn from."""
    extent = cells.agg(F.countDistinct("entity").alias("entities"), F.countDistinct("period").alias("periods"), F.count("ret").alias("n_returns"), F.count_if(F.col("ret").isNull()).alias("n_missing"))
    return cells.sparkSession.createDataFrame(ASSUMPTIONS, "assumption string, detail string").crossJoin(F.broadcast(extent))  # one row
