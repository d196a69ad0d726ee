"""What the operators of this subpackage share: tables, row selection; tables that are written on the way are pageforge.storage's."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.storage import forget, new_path  # noqa: F401
from pageforge.storage import stored as materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id="doc_id"):
    """True for the rows that no classifier learns from: crc32 of doc_id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """At most max_rows labelled rows that aren't held out, of texts of at most max_bytes, as (text, label).

    The choice is by a hash, so any subset of the ids is as likely as another; ids are no inputs of a score.
    Rows without a label don't count; an id with several labels takes the largest.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    )
    short = documents.where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes)
    ids = short.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = materialize(ids, "training-ids")  # at most max_rows ids: small enough to broadcast
    rows = short.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(ids), "doc_id")
    return materialize(rows.select(F.col("_text").alias("text"), F.col("_label").alias("label")), "training-rows")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def give_back() -> None:
    """What a task has freed goes back to the machine: Python workers live on, and would keep it beside the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, rows: int = 256):
    """The batches, a few rows at a time, so that few texts are held as Python strings at once; memory is given back after
    the last."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()
