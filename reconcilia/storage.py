"""Intermediate tables: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Where neither is set, a session whose executors are threads of this process gets a temporary folder,
    removed at the end; on a cluster no folder can be guessed, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and sc.master.split("[")[0] == "local":
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/")


#: Paths of the tables written inside each open ``scratch``.
_OPEN: list[list[str]] = []


def written(df: DataFrame, *partitions: str) -> str:
    """The path of a new table in the shared folder that holds ``df``."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    for paths in _OPEN:
        paths.append(path)
    return path


def saved(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: cuts lineage, survives lost executors.

    ``partitions``: columns by which the table is split into folders, so that a filter on them reads its folder only.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, *partitions))


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables saved inside are removed at the end, but for paths that the caller takes out of the list: for callers that have written their result by then."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)
        remove(spark, paths)
