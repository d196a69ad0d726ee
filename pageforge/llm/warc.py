"""WARC archives: written per page, read back, and assembled into captures.

Every page gives a request, a response (or a revisit, where an earlier page has the same payload) and a metadata
record, tied together by WARC-Concurrent-To. Records are text, so Spark's own writer puts them into any store and
commits them safely, compressed: the two line ends that close a record are the writer's line separator. The writer
compresses a file as one gzip member, so files are read whole, one at a time and of bounded size, and cut by
Content-Length. Payloads are never shuffled, as long as revisits are few enough to broadcast. Captures are assembled by a
join through the concurrent-to ids, one nested row each.

Defined results: null html is an empty payload; payloads under LEAST bytes are always responses; of rows that repeat a
page_id with one payload, one is the response, and rows without an id come last; of several requests or metadata records
of a capture, the one with the smallest record id is shown; other columns are ignored; no pages give no records.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.storage import new_path, stored

LEAST = 100
#: Revisits that are broadcast at most, of some 50 bytes each.
MAX_BROADCAST = 500_000
#: Bytes of a file before compression, roughly.
FILE = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _id(kind: str, key: str) -> str:
    """A record id of 32 hex digits from a row's key, as SQL."""
    return f"concat('<urn:uuid:', regexp_replace(md5(concat('{kind}:', {key})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-'), '>')"


def _record(kind: str, lines: list[str], block: str) -> str:
    """A record as SQL: header lines are SQL strings, the block is a SQL string."""
    head = ", '\\r\\n', ".join(["'WARC/1.1'", f"concat('WARC-Type: ', {kind})", *lines, f"concat('Content-Length: ', octet_length({block}))"])
    return f"concat({head}, '\\r\\n\\r\\n', {block})"


def repeats(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(again, first): the numbers of rows (_row, page_id, sha, bytes) that revisit, and the row that they revisit, as
    (page_id, _row). Digests are counted before they are shuffled, and payloads stay where they are; a digest that very
    many rows share is split by its join's skew, which holds numbers only."""
    long = rows.where(F.col("bytes") >= least).select("_row", "page_id", "sha")
    first = long.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")).alias("f"), F.count("*").alias("n"))
    first = first.where("n > 1").select("sha", F.struct("f.page_id", "f._row").alias("first"))
    return long.join(first, "sha").where("_row <> first._row").select(F.col("_row").alias("again"), "first")


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Per page, `record`: its three records, as text joined by the separator.

    pages is read twice, for digests and for records, and must give the same rows in the same partitions both times, as
    a table does; store other results first."""
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("_row")
    ).withColumn("sha", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html"))
    found = stored(repeats(rows, least), "warc-repeats")
    # few enough of them go to all tasks; else both sides are dealt by row number, which no rows share
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST else found
    rows = rows.join(found, F.col("_row") == F.col("again"), "left").withColumn("again", F.col("again").isNotNull())
    key, origin = "concat_ws('-', page_id, _row)", "concat_ws('-', first.page_id, first._row)"
    rows = rows.withColumn("uri", F.regexp_replace("url", r"[\x00-\x20]", "%20")).withColumn(
        "http", F.expr("concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', bytes, '\\r\\n\\r\\n')")
    )
    main, ask, meta = _id("capture", key), _id("request", key), _id("metadata", key)
    target = ["concat('WARC-Target-URI: ', uri)", f"'WARC-Date: {DATE}'"]
    digest = "concat('WARC-Payload-Digest: sha256:', sha)"
    full = _record("'response'", [f"concat('WARC-Record-ID: ', {main})", *target, "'Content-Type: application/http;msgtype=response'", digest], "concat(http, html)")
    same = _record("'revisit'", [f"concat('WARC-Record-ID: ', {main})", *target, "'Content-Type: application/http;msgtype=response'", digest, f"'WARC-Profile: {PROFILE}'", f"concat('WARC-Refers-To: ', {_id('capture', origin)})"], "http")
    request = _record("'request'", [f"concat('WARC-Record-ID: ', {ask})", *target, "'Content-Type: application/http;msgtype=request'", f"concat('WARC-Concurrent-To: ', {main})"], "concat('GET ', uri, ' HTTP/1.1\\r\\n\\r\\n')")
    metadata = _record("'metadata'", [f"concat('WARC-Record-ID: ', {meta})", *target, "'Content-Type: application/warc-fields'", f"concat('WARC-Concurrent-To: ', {main})"], "concat('page-id: ', coalesce(CAST(page_id AS STRING), ''), '\\r\\n')")
    between = "'\\r\\n\\r\\n'"
    return rows.select(F.expr(f"concat({request}, {between}, CASE WHEN again THEN {same} ELSE {full} END, {between}, {metadata})").alias("record"))


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE) -> None:
    """Writes the pages' records as WARC files under path."""
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))) + 1500)).first()[0] or 1
    # files are cut by rows, not by another shuffle of the payloads
    records(pages, least).write.option("maxRecordsPerFile", max(1, int(file_bytes / mean))).option("lineSep", END).option("compression", "gzip").text(path)


def parse(data: bytes):
    """The records of one file: (headers with lower-case names, block)."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.lower()] = value.strip()
        start, size = end + 4, int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield head, memoryview(data)[start : start + size]
        at = start + size + 4


SCHEMA = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, "
    "payload_bytes long, payload_digest string, page_id long, payload string"
)


def _read(with_payload: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, size, sha, page, payload = head["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        raw = bytes(block)
                        http, _, body = raw.partition(b"\r\n\r\n")
                        size = len(body)
                        sha = hashlib.sha256(body).hexdigest()
                        if kind == "revisit":  # its payload is in the record that it refers to
                            size = next(int(x[15:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:"))
                            sha = head["warc-payload-digest"].rpartition(":")[2]
                        elif with_payload:
                            payload = body.decode("utf-8", "surrogatepass")
                    elif kind == "metadata":
                        page = next((int(x[8:]) for x in bytes(block).decode().split("\r\n") if x.startswith("page-id:") and x[8:].strip()), None)
                    named = (head.get(f"warc-{n}") for n in ("concurrent-to", "refers-to", "target-uri", "date", "payload-digest"))
                    rows.append((head["warc-record-id"], kind, *named, size, sha, page, payload))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files under path, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload), SCHEMA)


def captures(found: DataFrame) -> DataFrame:
    """One row per transaction: request, response (or revisit) and metadata, joined through concurrent-to ids, and the
    page_id of the capture that a revisit refers to."""
    # all three share the key, so one shuffle joins them
    keyed = found.withColumn("id", F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")))
    record = F.struct("record_id", "type", "uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload")

    def part(*kinds: str):
        """Of several records of a kind, the one with the smallest id."""
        own = F.col("type").isin(*kinds)
        return F.min_by(F.when(own, record), F.when(own, F.col("record_id")))

    whole = keyed.where("id IS NOT NULL").groupBy("id").agg(
        part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"), F.max("page_id").alias("page_id")
    )
    wanted = whole.select(F.col("response.refers_to").alias("wanted")).where("wanted IS NOT NULL").distinct()
    origin = whole.join(wanted, F.col("id") == F.col("wanted"), "left_semi").select(F.col("id").alias("_origin"), F.col("page_id").alias("refers_to"))
    return whole.join(origin, F.col("response.refers_to") == F.col("_origin"), "left").drop("_origin")


def round_trip(pages: DataFrame, least: int = LEAST, path: str | None = None) -> DataFrame:
    """Writes the pages, reads the archives back, and returns the captures without their payloads."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, least)
    # parsed once, for the joins of captures
    return captures(stored(read(spark, path, with_payload=False), "warc-records"))
