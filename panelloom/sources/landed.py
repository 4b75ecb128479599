"""Landed documents as a data source: one partition for each file that a snapshot's manifest names.

A folder has a folder `snapshot_id=<id>` for each snapshot, with a manifest (JSON: `raw_files`, `gap_files`, and what else the
snapshot says about itself) and the files. A name in the manifest stands for its compressed form (.json.gz) where there is one, else
for the plain one (.json); a file that is missing or empty is an error. The options snapshot_id and kind say what is planned at all, so
files of other snapshots are not opened. (They are options and no pushed-down filters, as Spark keeps one reader for each load: two branches
of a plan that filter one load differently would both get the files of the last.) A row is a file: its document is parsed by
Spark, with the schema that the caller declares.

    spark.dataSource.register(Landed)
    spark.read.format("landed").option("folder", folder).option("snapshot_id", "s1").load()
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "snapshot_id string, kind string, file string, document string"
#: Lists of a manifest, and the kind of their files.
KINDS = {"raw_files": "raw", "gap_files": "gap"}
ENDS = (".json.gz", ".json")


def _at(folder: str):
    """The file system and path of a folder, local or not."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _stem(name: str) -> str:
    name = name.rsplit("/", 1)[-1]
    return next((name[: -len(e)] for e in ENDS if name.endswith(e)), name)


@dataclass
class LandedFile(InputPartition):
    snapshot: str
    kind: str
    path: str


class LandedReader(DataSourceReader):
    def __init__(self, folder: str, manifest: str, snapshot: str | None, kind: str | None):
        self.folder, self.manifest, self.snapshot, self.kind = folder, manifest, snapshot, kind

    def partitions(self) -> Sequence[LandedFile]:
        from pyarrow import fs

        system, top = _at(self.folder)
        out = []
        for found in sorted(system.get_file_info(fs.FileSelector(top)), key=lambda i: i.path):
            snapshot = found.base_name.removeprefix("snapshot_id=")
            if found.type != fs.FileType.Directory or snapshot == found.base_name or self.snapshot not in (None, snapshot):
                continue
            with system.open_input_stream(f"{found.path}/{self.manifest}") as f:
                says = json.loads(f.read())
            for key, kind in KINDS.items():
                if self.kind in (None, kind):
                    out += [LandedFile(snapshot, kind, f"{found.path}/{_stem(name)}") for name in says.get(key, [])]
        return out

    def read(self, partition: LandedFile | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # nothing was planned
            return
        system, _ = _at(self.folder)
        for end in ENDS:
            info = system.get_file_info(partition.path + end)
            if info.type != fs.FileType.File:
                continue
            with system.open_input_stream(info.path, compression=None) as f:
                raw = f.read()
            text = gzip.decompress(raw) if end.endswith(".gz") and raw else raw
            if not text.strip():
                raise ValueError(f"{info.path} is empty")
            yield (partition.snapshot, partition.kind, info.base_name, text.decode())
            return
        raise FileNotFoundError(f"no {partition.path}.json.gz or {partition.path}.json")


class Landed(DataSource):
    """format("landed"); options: folder, manifest (its name, manifest.json by default), snapshot_id and kind (all by default)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        o = self.options
        return LandedReader(o["folder"], o.get("manifest", "manifest.json"), o.get("snapshot_id"), o.get("kind"))


def read_landed(spark: SparkSession, folder: str, snapshot: str | None = None, kind: str | None = None) -> DataFrame:
    """(snapshot_id, kind, file, document): a row for each file of the snapshot and kind, or of all."""
    spark.dataSource.register(Landed)
    own = {"folder": folder, "snapshot_id": snapshot, "kind": kind}
    return spark.read.format("landed").options(**{k: v for k, v in own.items() if v is not None}).load()


def manifest_of(folder: str, snapshot: str, manifest: str = "manifest.json") -> dict[str, Any]:
    system, top = _at(folder)
    with system.open_input_stream(f"{top}/snapshot_id={snapshot}/{manifest}") as f:
        return json.loads(f.read())


def land(documents: DataFrame, folder: str, snapshot: str, says: dict[str, Any] | None = None) -> str:
    """Write documents (kind, stem, document), one file each and compressed, as a new snapshot of folder; the manifest comes last.

    Files are written by the tasks that hold the documents; a repeated task writes the same bytes under the same name.
    What returns to the driver is the list of names that the manifest holds.
    """
    at = f"{folder.rstrip('/')}/snapshot_id={snapshot}"

    def write(batches):
        import pandas as pd

        system, top = _at(at)
        system.create_dir(top, recursive=True)
        for b in batches:
            for stem, text in zip(b["stem"], b["document"], strict=True):
                with system.open_output_stream(f"{top}/{stem}.json.gz", compression=None) as f:
                    f.write(gzip.compress(text.encode(), mtime=0))
            yield pd.DataFrame({"kind": b["kind"], "stem": b["stem"]})

    names = documents.select("kind", F.col("stem").cast("string"), "document").mapInPandas(write, "kind string, stem string").collect()  # a row for each file
    system, top = _at(at)
    system.create_dir(top, recursive=True)
    lists = {key: sorted(r["stem"] for r in names if r["kind"] == kind) for key, kind in KINDS.items()}
    with system.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(lists | (says or {}), sort_keys=True).encode())
    return at
