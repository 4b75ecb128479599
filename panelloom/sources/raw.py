"""Landed raw documents: nested JSON histories, factor chunks named by a manifest, snapshots and small outputs."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nearest_utc_day, no_nan, utc_day

# The formats in which the documents arrive.
HISTORY = "name string, tvl array<struct<date: bigint, totalLiquidityUSD: double>>"
SERIES = "date bigint, totalCirculatingUSD struct<peggedUSD: double>"
FACTOR = "coins map<string, struct<symbol: string, confidence: double, price: double, timestamp: bigint, prices: array<struct<timestamp: bigint, price: double>>>>"


def raw_path(folder: str, stem: str) -> str:
    """The compressed file of this stem if there is one, else the plain one, else an error."""
    for end in (".json.gz", ".json"):
        path = os.path.join(folder, stem + end)
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"no {stem}.json.gz or {stem}.json in {folder}")


def read_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Whole-file JSON, plain or compressed by its ending."""
    return spark.read.schema(schema).json(paths, multiLine=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; a value that does not fit is an error."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def entity_history(docs: DataFrame, entity: str | Column, name: str | Column, category: str | Column) -> DataFrame:
    """(period, observed_at, entity, name, category, value); items without date or value are left out, days are rounded down."""
    item = docs.select(F.coalesce("name", F.lit(name)).alias("name"), F.lit(entity).alias("entity"), F.lit(category).alias("category"), F.explode("tvl").alias("x"))
    value = no_nan(F.col("x.totalLiquidityUSD"))
    rows = item.select(utc_day(F.col("x.date")).alias("period"), F.col("x.date").alias("observed_at"), "entity", "name", "category", value.alias("value"))
    return rows.where("observed_at IS NOT NULL AND value IS NOT NULL")


def aggregate_series(docs: DataFrame) -> DataFrame:
    """(period, observed_at, value) of an aggregate series."""
    value = no_nan(F.col("totalCirculatingUSD.peggedUSD"))
    return docs.select(utc_day(F.col("date")).alias("period"), F.col("date").alias("observed_at"), value.alias("value")).where("observed_at IS NOT NULL AND value IS NOT NULL")


def factor_prices(chunks: DataFrame, gaps: DataFrame | None, coin: str, until: str | None = None) -> DataFrame:
    """(period, observed_at, level): chunk prices and single gap observations, to the nearest day, the last of each day.

    Of observations at one time the larger level stays; a chunk without prices is an error.
    """
    from ..operators.panel import clean_latest

    if not chunks.where(F.coalesce(F.size(F.col("coins")[coin]["prices"]), F.lit(0)) <= 0).isEmpty():
        raise ValueError(f"a chunk has no prices for {coin}")
    rows = chunks.select(F.explode(F.col("coins")[coin]["prices"]).alias("p")).select("p.timestamp", "p.price")
    if gaps is not None:
        rows = rows.unionByName(gaps.select(F.col("coins")[coin]["timestamp"].alias("timestamp"), F.col("coins")[coin]["price"].alias("price")))
    day = rows.select(nearest_utc_day(F.col("timestamp")).alias("period"), F.col("timestamp").alias("observed_at"), no_nan(F.col("price")).alias("value"))
    if until is not None:
        day = day.where(F.col("period") <= F.lit(until).cast("date"))
    return clean_latest(day, ["period"], "observed_at", float("-inf")).withColumnRenamed("value", "level")


def factor_from_manifest(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """The factor series that a manifest describes: coin_identifier, raw_files, gap_files, sample_cutoff."""
    with open(os.path.join(folder, manifest)) as f:
        m = json.load(f)
    at = lambda names: [os.path.join(folder, os.path.basename(n)) for n in names]
    gaps = read_json(spark, at(m["gap_files"]), FACTOR) if m.get("gap_files") else None
    return factor_prices(read_json(spark, at(m["raw_files"]), FACTOR), gaps, m["coin_identifier"], m.get("sample_cutoff"))


def factor_from_landed(spark: SparkSession, folder: str, snapshot: str) -> DataFrame:
    """The factor series of a landed snapshot: its manifest's coin_identifier, chunks, gap files and sample_cutoff."""
    from .landed import manifest_of, read_landed

    m = manifest_of(folder, snapshot)
    chunks, gaps = (read_landed(spark, folder, snapshot, k).select(F.from_json("document", FACTOR).alias("d")).select("d.*") for k in ("raw", "gap"))
    return factor_prices(chunks, gaps if m.get("gap_files") else None, m["coin_identifier"], m.get("sample_cutoff"))


def write_snapshot(df: DataFrame, folder: str, keys: list[str], stamp: str | None = None) -> tuple[str, dict[str, Any]]:
    """Write df to a new snapshot folder, never over an old one; returns its path and the counts for a manifest."""
    from ..operators.panel import duplicate_keys

    stamp = stamp or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    path = f"{folder}/snapshot_id={stamp}"
    counts = duplicate_keys(df, keys).first()
    df.write.mode("errorifexists").parquet(path)
    return path, {"raw_rows": counts["n_rows"], "staged_rows": counts["n_keys"], "duplicates_removed": counts["n_surplus"]}


def register(tables: dict[str, DataFrame]) -> None:
    """Tables by name for spark.sql, each in place of an earlier one of its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def full_refresh(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """All tables written as one new version of folder; returns their paths.

    A version is a folder of its own; readers follow the pointer `_current`, which is replaced only after every table is
    there. A refresh that fails leaves the version before as it was.
    """
    from .landed import _at

    version = f"version={datetime.now(UTC).strftime('%Y%m%dT%H%M%S%fZ')}"
    paths = {name: f"{folder}/{version}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(paths[name])
    system, top = _at(folder)
    with system.open_output_stream(f"{top}/_next") as f:
        f.write(json.dumps({"version": version, "tables": sorted(tables)}).encode())
    system.move(f"{top}/_next", f"{top}/_current")
    return paths


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last complete refresh."""
    from .landed import _at

    system, top = _at(folder)
    with system.open_input_stream(f"{top}/_current") as f:
        m = json.loads(f.read())
    return {name: spark.read.parquet(f"{folder}/{m['version']}/{name}") for name in m["tables"]}


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_summary(values: dict[str, Any], path: str) -> None:
    with open(path, "w") as f:
        json.dump(values, f, indent=2, sort_keys=True, default=str)
