"""Best-fit packing of documents into sequences of a fixed length.

One pass tokenizes and cuts documents into pieces. The histogram of piece lengths (at most `limit` rows) is all that
the driver plans on: best fit over counts, so a plan of a few thousand slot ranges serves any number of documents.
Pieces then take planned slots by their rank within their length. The rank is counted in buckets, so that a length
that a third of all pieces share is not ranked in one task.

Defined results: null or empty text is the end id alone; a document longer than the limit is cut into pieces of the
limit, of which the first may be shorter; an empty table gives an empty result; rows that repeat a doc_id are packed
once each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageforge.llm.common import materialize
from pageforge.llm.tokens import crc, encoder

LIMIT, END = 1024, 2
#: Slot ranges that are broadcast at most.
SLOTS = 100_000


def _pieces(path: str, limit: int, end_id: int):
    def run(batches):
        encode, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            docs, rows, texts = (batch.column(i).to_pylist() for i in range(3))
            encoded = (x for k in range(0, len(texts), 256) for x in encode.many(texts[k : k + 256]))
            for doc, row, ids in zip(docs, rows, encoded):
                ids += end
                n = len(ids) // 4
                start, k = 0, 0
                length = (n - 1) % limit + 1
                while start < n:
                    out.append((doc, row, k, start, length, crc(ids[4 * start : 4 * (start + length)])))
                    start, k, length = start + length, k + 1, limit
            if not out:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "_row", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text").mapInArrow(
        _pieces(vocabulary, limit, end_id), f"doc_id {kind}, _row long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Slot ranges (length, first rank, ranks, first sequence, offset): rank r of a length goes into
    sequence first + r - first rank, at the offset. Longest first, each into the fullest open sequences that have room."""
    room: dict[int, list[tuple[int, int]]] = {}  # open sequences by what is left in them: (first sequence, how many)
    lefts: list[int] = []  # the keys of room, sorted
    made, slots = 0, []

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                insort(lefts, left)
            room[left].append((first, many))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            at = bisect_left(lefts, length)
            if at == len(lefts):  # none has room: open what the rest needs, each filled as far as this length goes
                fits = limit // length
                full, over = divmod(count - rank, fits)
                for k in range(fits):
                    if full:
                        slots.append((length, rank, full, made, k * length))
                        rank += full
                put(limit - fits * length, made, full)
                made += full
                for k in range(over):
                    slots.append((length, rank, 1, made, k * length))
                    rank += 1
                if over:
                    put(limit - over * length, made, 1)
                    made += 1
                break
            left = lefts[at]
            first, many = room[left].pop()
            if not room[left]:
                del room[left]
                lefts.pop(at)
            take = min(many, count - rank)
            slots.append((length, rank, take, first, limit - left))
            rank += take
            put(left - length, first, take)
            put(left, first + take, many - take)
    return slots


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, limit, end_id), "pieces")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row", "piece"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `limit` rows
    plan = best_fit(histogram, limit)
    slots = spark.createDataFrame(plan, "length long, _lo long, _many long, _first long, offset long")
    within = Window.partitionBy("length", "_bucket").orderBy("_row", "piece")
    ranked = (
        cut.withColumn("_k", F.row_number().over(within) - 1)
        .join(counts.select("length", "_bucket", "_base"), ["length", "_bucket"])
        .withColumn("_rank", F.col("_base") + F.col("_k"))
    )
    # a few ranges for each length, whatever the input; should there be more, Spark picks the join
    placed = ranked.join(F.broadcast(slots) if len(plan) <= SLOTS else slots, "length").where("_rank >= _lo AND _rank < _lo + _many")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset"
    )
