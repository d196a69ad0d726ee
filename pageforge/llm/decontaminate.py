"""Benchmark decontamination with DataFrame functions only.

Test items are normalised to words and cut into windows. A hash set of all windows goes to the executors inside the plan:
the hashes themselves up to MAX_SET of them (counted first), from there up to MAX_BLOOM a Bloom table of some twelve bits
a window, which takes three times as long to ask. Each document probes it with the hash of every window of its own words,
in one pass and without a shuffle of texts. Windows that hit are verified by their words: only they are joined with the
items' windows. Beyond MAX_BLOOM windows, hashes are exploded and joined, and the hits go back to their documents for the
same verification.

Defined results: null text, or text without words, has no words and no hits; an item without words is ignored; an item
that repeats, or items that share windows, all count; rows that repeat a doc_id each get a result row; documents of any
length are scanned whole; an empty table on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import ascii_lower, materialize, union_all

WINDOW = 10
#: Windows that a plan holds as a set of hashes, as a Bloom table, and that table's bits for each.
MAX_SET, MAX_BLOOM, BITS = 20_000, 4_000_000, 12
#: Bytes of windows, with the ids of their items, that are broadcast at most; rows that hits are dropped by, likewise.
MAX_BROADCAST, MAX_ROWS = 32 << 20, 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(column):
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(column, F.lit(""))), GAP), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, text, h, items): distinct windows, their hash, and the sorted ids of the items that have them."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.lit(window), F.size("w")))
    cut = items.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("x"))
    return cut.groupBy("size", F.concat_ws(" ", "x").alias("text"), F.xxhash64("x").alias("h")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _places(h, bits: int) -> list:
    """The two bits of a Bloom table that a hash has."""
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h), F.lit(bits))]


def bloom(windows: DataFrame, many: int) -> tuple[bytes, int]:
    """A Bloom table of the hashes of `many` windows, six bits a byte as characters from 0 on, and its number of bits."""
    bits = max(6 << 10, BITS * many // 6 * 6)
    places = windows.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("p"))
    found = places.groupBy((F.col("p") / 6).cast("long").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(p % 6 AS INT))")).alias("v"))
    # put in order by stretches of 64 KB, each of which comes to the driver as one string
    whole = windows.sparkSession.range(bits // 6).withColumnRenamed("id", "byte").join(found, "byte", "left")
    each = F.array_sort(F.collect_list(F.struct("byte", F.chr(F.lit(48) + F.coalesce("v", F.lit(0))).alias("c"))))
    parts = whole.groupBy((F.col("byte") / (1 << 16)).cast("long").alias("k")).agg(F.array_join(F.transform(each, lambda x: x["c"]), "").alias("part"))
    return "".join(r["part"] for r in parts.orderBy("k").collect()).encode(), bits


def among(hashes: list[int]):
    """Whether a hash is one of these, which Spark holds as a hash set."""
    return lambda h: h.isin(hashes)


def in_table(table: bytes, bits: int):
    """Whether a hash may be one of those in a Bloom table."""
    known = F.lit(bytearray(table))

    def has(p):
        byte = F.ascii(F.substring(known, (F.floor(p / 6) + 1).cast("int"), F.lit(1)).cast("string")) - 48
        return F.call_function("shiftright", byte, (p % 6).cast("int")) % 2 == 1

    def within(h):
        one, two = _places(h, bits)
        return has(one) & has(two)

    return within


def _by_set(docs: DataFrame, sizes: list[int], within) -> DataFrame:
    """docs and `hits`, an array of (at, size, text) of windows that the set has, or may have."""

    def probed(size: int):
        last = F.size("w") - (size - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        found = F.filter(places, lambda i: within(F.xxhash64(F.slice("w", i, F.lit(size)))))
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.concat_ws(" ", F.slice("w", i, F.lit(size))).alias("text")))

    return docs.withColumn("hits", F.concat(*[probed(size) for size in sizes]))


def _by_join(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by a join on the hash; texts are shuffled once, for the documents with hits."""
    hashed = union_all([
        docs.select("doc_id", "_h", F.lit(size).alias("size"), F.posexplode(F.expr(
            f"transform(IF(size(w) >= {size}, sequence(1, size(w) - {size - 1}), array()), i -> xxhash64(slice(w, i, {size})))")).alias("at", "h"))
        for size in sizes
    ])
    place = F.struct((F.col("at") + 1).alias("at"), "size")
    met = hashed.join(windows.select("size", "h").distinct(), ["size", "h"]).groupBy("doc_id", "_h").agg(F.collect_set(place).alias("_met"))
    hits = F.expr("transform(coalesce(_met, array()), m -> struct(m.at AS at, m.size AS size, concat_ws(' ', slice(w, m.at, m.size)) AS text))")
    met = materialize(met.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_text"), "_met"), "window-hits")
    return docs.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_text")), "left").withColumn("hits", hits).drop("_met", "_id", "_text")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, max_bloom: int = MAX_BLOOM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of docs: doc_id, _h (a hash of the text), n_words, n_hit, items (sorted ids as strings), positions
    (hit words, from 1)."""
    windows = materialize(item_windows(benchmark, window), "windows")
    weight = F.sum(F.octet_length("text") + F.expr("aggregate(items, 32L, (s, x) -> s + octet_length(x) + 16)"))
    counted = windows.groupBy("size").agg(F.count("*"), weight).collect()  # at most `window` rows
    sizes, weight = {r[0]: r[1] for r in counted}, sum(r[2] for r in counted)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("_h"), words_of(F.col("text")).alias("w"))
    total = sum(sizes.values())
    if not total:
        empty = F.array().cast("array<string>")
        none = F.lit(0).cast("long").alias("n_hit"), empty.alias("items"), F.array().cast("array<int>").alias("positions")
        return rows.select("doc_id", "_h", F.size("w").cast("long").alias("n_words"), *none)
    if total <= max_set:
        found = _by_set(rows, sorted(sizes), among([r[0] for r in windows.select("h").distinct().collect()]))
    elif total <= max_bloom:
        found = _by_set(rows, sorted(sizes), in_table(*bloom(windows, total)))
    else:
        found = _by_join(rows, windows, sorted(sizes))
    known = windows.select("text", "items")
    hits = found.select("_row", "doc_id", "_h", F.size("w").cast("long").alias("n_words"), F.explode_outer("hits").alias("hit"))
    hits = hits.select("_row", "doc_id", "_h", "n_words", "hit.at", "hit.size", "hit.text")
    verified = hits.join(F.broadcast(known) if weight <= max_broadcast else known, "text", "left")
    span = F.when(F.col("items").isNotNull(), F.sequence("at", F.col("at") + F.col("size") - 1))
    return (
        verified.groupBy("_row", "doc_id", "_h", "n_words")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list(span))).alias("positions"))
        .select("doc_id", "_h", "n_words", F.size("positions").cast("long").alias("n_hit"), "items", "positions")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without the documents that hold a benchmark window (mode "documents"), or without the words inside such
    windows (mode "spans"; what stood between words stays, n_chars follows the new text)."""
    # the documents' own columns travel in one struct, so that no name of theirs can clash
    columns = docs.columns
    found = find(docs, benchmark, window).where("n_hit > 0").groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_text"))
    found = materialize(found.agg(F.first("positions").alias("positions")), "contaminated")
    ids = found.select("_id", "_text")
    # texts stay where they are as long as what is dropped is few rows of an id and a hash
    ids = F.broadcast(ids) if found.count() <= max_rows else ids
    keyed = docs.select(F.struct(*columns).alias("_own"))
    own = lambda name: F.col("_own").getField(name)
    same = own("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(own("text")) == F.col("_text"))
    if mode == "documents":
        return keyed.join(ids, same, "left_anti").select([own(c).alias(c) for c in columns])
    if mode != "spans":
        raise ValueError(f"no such mode: {mode}")
    joined = keyed.join(found, same, "left").withColumn("_t", own("text"))
    joined = joined.withColumn("_w", F.expr(f"regexp_extract_all(_t, '{_raw(WORD)}', 0)")).withColumn("_g", F.expr(f"split(_t, '{_raw(WORD)}', -1)"))
    rest = "array_join(transform(_g, (g, i) -> concat(g, IF(i >= size(_w) OR array_contains(positions, i + 1), '', coalesce(get(_w, i), '')))), '')"
    hit = F.col("positions").isNotNull() & F.col("_t").isNotNull()
    new = {"text": F.when(hit, F.expr(rest)).otherwise(F.col("_t"))}
    joined = joined.withColumn("_new", new["text"])
    if "n_chars" in columns:
        new["n_chars"] = F.when(hit, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    new["text"] = F.col("_new")
    return joined.select([new.get(c, own(c)).alias(c) for c in columns])


def _raw(pattern: str) -> str:
    """The pattern for a SQL string: words are what the pattern takes in either case."""
    return pattern.replace(r"\x3A-\x60\x7B-\x7F", r"\x3A-\x40\x5B-\x60\x7B-\x7F").replace("\\", "\\\\")
