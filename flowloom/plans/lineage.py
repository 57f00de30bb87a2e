"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or else the one given to ``setCheckpointDir``.

    Where there is neither, a session on this machine alone gets a temporary folder; on a
    cluster that would be a folder which other machines do not see, so it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return context.getCheckpointDir().rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/flowloom/{spark.sparkContext.applicationId}"


_open = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later stages then restart from the table, and what was decided once (names,
    samples, labels) is not decided again when a task is run again. Lazy results read
    tables, so they stay until ``settled``, ``scratch`` or ``cleared`` delete them.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that are written inside, but for those whose paths are taken off the list."""
    scopes = _open.scopes = getattr(_open, "scopes", [])
    scopes.append([])
    try:
        yield scopes[-1]
    finally:
        for path in scopes.pop():
            _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a written table; the tables that it wrote on the way are deleted."""
    with scratch(spark) as tables:
        out = written(make())
        kept = tables.pop()
    if _open.scopes:
        _open.scopes[-1].append(kept)
    return out


def cleared(spark: SparkSession) -> None:
    """Delete all tables that this application has written; to be called when its results have been stored."""
    _delete(spark, _own(spark))
