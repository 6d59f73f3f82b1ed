"""Intermediate results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset it is a temporary one, if all runs in one process (local
    tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="lodestone-")
    return named


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in folder() for what cut() writes meanwhile. It is deleted at the end: nothing that reads it may be left."""
    path = f"{folder(spark)}/lodestone-{uuid.uuid4().hex}"
    before = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(before)
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at the path, read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(spark: SparkSession) -> str:
    """A path that cut() would take."""
    return f"{_SCRATCH.get() or folder(spark)}/lodestone-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in folder(), read again. The folder's owner cleans it up, but for what is written within scratch()."""
    return kept(df, place(df.sparkSession))
