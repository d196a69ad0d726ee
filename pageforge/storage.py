"""Tables that a plan writes on its way, in the folder that all executors share.

A result reads some of them, so they stay until the caller is done with it: what is stored inside `with scratch(spark):`
goes when the block ends, after success and after failure; what is stored outside of any block goes with release(spark).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders that are in use: those of no block, then those of each open block.
_OPEN: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session of one machine gets a temporary one, which goes
    when Python ends; on a cluster that would be another folder on each machine, so it is an error there."""
    base = spark.conf.get(KEY, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share; the master is {master!r}")
        base = tempfile.mkdtemp(prefix="pageforge-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A folder's name that goes with the innermost open block."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """What is stored inside goes when the block ends. The block gets a function that keeps a stored table for the block
    around it."""
    _OPEN.append([])

    def keep(df: DataFrame) -> DataFrame:
        _OPEN[-1].remove(df.stored_at)
        _OPEN[-2].append(df.stored_at)
        return df

    try:
        yield keep
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes what was stored outside of any block; results that read it can't be used after this."""
    while _OPEN[0]:
        _delete(spark, _OPEN[0].pop())


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, which nothing that is still to run may need."""
    path = getattr(df, "stored_at", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    for paths in _OPEN:
        if path in paths:
            paths.remove(path)
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so that it works for any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
