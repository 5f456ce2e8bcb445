"""Cutting lineage so that lost executors cost no data."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_NAMED: set[str] = set()
_SCOPES = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only local mode (tests) may do without: a folder of one
    machine would scatter the tables of a cluster, so there a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master!r}")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="veilframe-"))
    return "file://" + _LOCAL[0]


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _own_folder(spark: SparkSession) -> str:
    """The application's folder; the file system removes it when the driver's virtual machine ends, whatever became of
    the session before."""
    folder = f"{shared_folder(spark)}/veilframe-{spark.sparkContext.applicationId}"
    if folder not in _NAMED:
        system, path = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _NAMED.add(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as a table to the shared folder and read from there ever after.

    Used where a costly stage has several consumers, or where consumers must see the very same rows. The table is
    columnar and compressed, so consumers read only what they need, and it outlives any executor. It is deleted by
    ``release``, at the end of an enclosing ``temporary`` block, or with the driver.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for scope in getattr(_SCOPES, "stack", [])[-1:]:
        scope.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Deletes the tables of data frames that ``durable`` returned and nobody reads any more; others are left alone."""
    for table in tables:
        if table is not None and (text := getattr(table, "_durable_path", None)):
            system, path = _path(table.sparkSession, text)
            system.delete(path, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread makes durable within the block at its end; what is to stay has been written
    elsewhere by then. Blocks nest."""
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for text in stack.pop():
            system, path = _path(spark, text)
            system.delete(path, True)
