"""Helpers shared by the text operators: scratch tables, column handling, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine (tests) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a finished query drops its shuffle files at once, as its table is written."""
    before = spark.conf.get(_FREE_SHUFFLE, None)
    spark.conf.set(_FREE_SHUFFLE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLE)
        else:
            spark.conf.set(_FREE_SHUFFLE, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []  # the tables of each scratch() that is open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within, tables of materialise() are for now only: at the end they go, but for those that the function given makes.

    What is returned must rest on kept tables alone.
    """
    kept: list[str] = []
    _MADE.append([])

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        kept.append(_MADE[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _MADE.pop():
            discard(spark, path)
        if _MADE:  # an outer one decides about what is kept here
            _MADE[-1] += kept


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read again, and its path; it stays until discard()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    out, path = write_table(df, name)
    if _MADE:
        _MADE[-1].append(path)
    return out


def small_join(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", max_rows: int = 20_000) -> DataFrame:
    """Join a table of few rows: broadcast only if a count proves it small, else a plain join, which AQE may split."""
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return df.join(small, on, how)


def text_of(column: str) -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_texts(df: DataFrame, make, fields: str, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """One row out for each row in: the id, the columns of also, and those of fields.

    make() is called once for each task and gives a function from (ids, list of UTF-8 texts, null as
    empty) to the fields' columns, as Arrow arrays or lists. Only the named columns leave the scan.
    """
    from pyspark.sql.types import StructType

    keep = df.select(*[F.col(f"`{c}`") for c in (id_col, *also)])
    added = StructType.fromDDL(fields)
    schema = StructType([*keep.schema.fields, *added.fields])
    n_keep = len(keep.columns)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        fn = make()
        for b in batches:
            texts = [t or b"" for t in b.column(n_keep).to_pylist()]
            cols = fn(b.column(0).to_pylist(), texts)
            made = [c if isinstance(c, pa.Array) else pa.array(c, type=out.field(n_keep + i).type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(out.field(i).type) for i in range(n_keep)], *made], schema=out)

    source = df.select(*[F.col(f"`{c}`") for c in (id_col, *also)], F.col(f"`{text}`").cast("binary").alias("_utf8"))
    return source.mapInArrow(run, schema)
