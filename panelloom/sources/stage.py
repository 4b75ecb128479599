"""Tables between the steps of a query, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where a session on one machine names none is a temporary folder made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, whatever is built on it, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PARTS: ContextVar[dict | None] = ContextVar("parts", default=None)


@contextmanager
def one_query() -> Iterator[None]:
    """Within, each part is made once; a query within a query shares its parts."""
    token = _PARTS.set({}) if _PARTS.get() is None else None
    try:
        yield
    finally:
        if token is not None:
            _PARTS.reset(token)


def part(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A table that several steps of a query need: made and staged at its first use within one_query()."""

    @wraps(make)
    def held(spark: SparkSession, *args) -> DataFrame:
        parts, key = _PARTS.get(), (make.__qualname__, args)
        if parts is None:
            return make(spark, *args)
        if key not in parts:
            parts[key] = staged(make(spark, *args), make.__name__.strip("_"))
        return parts[key]

    return held
