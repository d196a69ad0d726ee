"""Token ids in ORC files, in ascending doc_id order.

Ids are array<int> columns, which ORC writes run-length encoded; files have row indexes and Bloom filters on doc_id, so
a reader that asks for some documents skips stripes and row groups, and every stripe can be read by a task of its own.
Rows are dealt by ranges of doc_id before they are encoded, so the ids themselves are never shuffled.

Defined results: null or empty text is the end id alone; rows that repeat a doc_id stand next to each other, in the
order of their texts; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageforge.llm.common import materialize
from pageforge.llm.tokens import crc, encoder

END = 2
#: Bytes of a stripe, rows of a row group.
STRIPE, STRIDE = 16 << 20, 1000


def _encode(path: str, end_id: int):
    def run(batches):
        encode, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [x + end for x in encode.many(part.column(1).to_pylist())]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END, partitions: int | None = None) -> None:
    """Writes (doc_id, ids) as ORC; part files ascend by doc_id, and so do the rows in each."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        dealt.mapInArrow(_encode(vocabulary, end_id), f"doc_id {kind}, ids array<int>")
        .write.option("orc.stripe.size", STRIPE).option("orc.row.index.stride", STRIDE)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids); with doc_ids, only those, by stripes and row groups that may hold them."""
    found = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))


def _digest(batches):
    for batch in batches:
        ids = batch.column(1)
        starts, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        data = memoryview(np.ascontiguousarray(values)).cast("B")
        bounds = (starts.astype(np.int64) * 4).tolist()
        crcs = [crc(data[a:b]) for a, b in zip(bounds, bounds[1:])]
        sizes = pa.array(np.diff(starts).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, pa.array(crcs, pa.int64()), batch.column(2), batch.column(3)],
            names=["doc_id", "n_tokens", "ids_crc32", "_file", "_at"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file's place is the number of the task that wrote it, and then the writer's count of its files: numbers, as names
    sort as texts only while they have as many digits. One row per file is what is ordered in one task and joined.
    """
    rows = spark.read.schema("doc_id long, ids array<int>").orc(path).select(
        "doc_id", "ids", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at")
    )
    sized = rows.mapInArrow(_digest, "doc_id long, n_tokens long, ids_crc32 long, _file string, _at long")
    part = [F.regexp_extract("_file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    sized = materialize(sized.withColumns({"_task": part[0], "_count": F.coalesce(part[1], F.lit(0))}).drop("_file"), "token-index")
    files = sized.groupBy("_task", "_count").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("_task", "_count").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_task", "_count").orderBy("doc_id", "_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(files, ["_task", "_count"])
        .select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
    )
