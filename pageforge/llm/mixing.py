"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Of all rates r that give each source its target of words, those are taken that stay closest to the documents as they
are: the least sum of r log r - r over documents, with words(source) = target and r <= MOST. The convex dual has one
multiplier a source, and its solution is an exponential tilt, r = min(MOST, exp(multiplier * size / mean size)).

Documents of one source and size have one rate, so everything up to the rates works on cells (source, size, documents),
which partial aggregation makes before anything is shuffled. Newton's steps solve the dual for all sources at once: a
round sums words and their slope over cells and moves each multiplier by Newton's step on the logarithm of its words, or
to the middle of what is known to hold the solution where the step leaves that. Multipliers stay in a table of one row
a source; what comes to the driver is one row a round.

Rates become whole copies per cell, rounded by a hash. What a source then lacks, or has too much, is mended in rounds:
in each, the largest size that fits gives as many copies more or less as fit. The copies of a cell go to its documents
evenly, the remainder by rank of a hash of doc_id, counted in buckets, so that no cell is ranked in one task. A target
is missed by less than the smallest size that can still change.

Defined results: null or blank text has size 0 and takes 0 words; a null source is a source of its own, the last; rows
that repeat a doc_id each count and get a row; rows that tie in all that decides are alike in all that is returned; an
empty table gives an empty result, a table without words has targets of 0; columns beside doc_id, source and text are
carried along by `mixed` and ignored by `shares`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageforge.llm.common import union_all
from pageforge.storage import forget, stored

WEIGHTS, MOST = (1, 2, 3), 3
#: Relative distance from a target at which Newton's steps end; rounds of steps and of mending at most.
CLOSE, ROUNDS, MENDS = 1e-7, 100, 64
#: Buckets in which the documents of a cell are ranked, at least.
BUCKETS = 64


def size_of(text):
    """Number of runs of anything but blanks and the characters from tab to carriage return."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, _s (the source as a key that is never null), size, _b (a bucket), and `more`."""
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s")
    return docs.select("doc_id", key, size_of(F.col("text")).alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("_b"), *more)


def targets(cells: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """_s, source_size, mean, least (of the sizes above 0) and target of each source of cells (_s, size, n). Sources by
    code point, null last, weigh `weights` in turn; a target stops at `most` times its source's size, and what is over
    is shared by weight among the others until none is above."""
    found = cells.groupBy("_s").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    turn = F.row_number().over(Window.orderBy(F.col("_s") == "", "_s")) - 1  # over one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long").alias("_w")
    rows = stored(found.select("_s", "source_size", "least", weight, (F.col("source_size") / F.col("_n")).alias("mean")), "mix-sources")
    total, free = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    left, bound = total, F.col("source_size") * most
    while True:
        share = F.col("_w") * F.lit(left / max(free, 1))
        full, rest = rows.agg(F.coalesce(F.sum(F.when(share > bound, bound)), F.lit(0)), F.coalesce(F.sum(F.when(share <= bound, F.col("_w"))), F.lit(0))).first()
        if (total - full, rest) == (left, free):
            return rows.withColumn("target", F.least(share, bound.cast("double"))).drop("_w")
        left, free = total - full, rest


def multipliers(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """goals (of targets()) with x, the multiplier at which the source's words come to its target."""
    spread = F.col("mean") / F.col("least")
    # at `high` all rates are `most`, at `low` no document gives more than its share of the target
    state = goals.where("target > 0").select(
        "*", (F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) * spread).alias("low"), (F.log(F.lit(float(most))) * spread).alias("high"),
    )
    full = F.col("target") >= F.col("source_size") * most
    start = F.when(full, F.col("high")).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = stored(state.withColumns({"x": start, "off": F.when(full, 0.0).otherwise(1.0)}), "mix-multipliers")
    for _ in range(ROUNDS):
        if state.where(F.col("off") > CLOSE).isEmpty():
            return state
        tilted = cells.where("size > 0").join(state.where(F.col("off") > CLOSE).select("_s", "x", "mean"), "_s").withColumn("r", _rate(most))
        words = F.col("n") * F.col("size") * F.col("r")
        summed = tilted.groupBy("_s").agg(F.sum(words).alias("_f"), F.sum(F.when(F.col("r") < most, words * F.col("size") / F.col("mean"))).alias("_d"))
        moved = state.join(summed, "_s", "left")
        below = F.col("_f") < F.col("target")
        low, high = F.when(below, F.col("x")).otherwise(F.col("low")), F.when(below, F.col("high")).otherwise(F.col("x"))
        step = F.col("x") - F.log(F.col("_f") / F.col("target")) * F.col("_f") / F.col("_d")
        x = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        off = F.abs(F.col("_f") / F.col("target") - 1)
        still = F.col("_f").isNotNull() & (off > CLOSE) & (low < high)
        changed = {"low": F.when(still, low).otherwise(F.col("low")), "high": F.when(still, high).otherwise(F.col("high")), "x": F.when(still, x).otherwise(F.col("x")),
                   "off": F.when(still, off).otherwise(0.0)}
        last, state = state, stored(moved.withColumns(changed).select(state.columns), "mix-multipliers")
        forget(last)
    return state


def _rate(most: int):
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("x") * F.col("size") / F.col("mean"))))


def cell_copies(cells: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """_s, size, n, m: the copies that all documents of each cell take together, mended to the targets."""
    u = F.pmod(F.xxhash64("_s", "size"), F.lit(1 << 20)) / float(1 << 20)
    rounded = cells.where("size > 0").join(solved.select("_s", "x", "mean"), "_s").withColumn("r", _rate(most))
    rounded = stored(rounded.select("_s", "size", "n", F.least(F.col("n") * most, F.floor(F.col("n") * F.col("r") + u).cast("long")).alias("m")), "mix-copies")
    taken = rounded.groupBy("_s").agg(F.sum(F.col("size") * F.col("m")).alias("_t"))
    # what each source lacks; the next size to change is below the last one
    lack = solved.join(taken, "_s").select("_s", (F.round("target").cast("long") - F.col("_t")).alias("lack"), F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("k"))
    picks = [stored(lack, "mix-lack")]
    room = F.when(F.col("lack") > 0, F.col("n") * most - F.col("m")).otherwise(F.col("m"))
    for _ in range(MENDS):
        now = picks[-1].select("_s", "lack", F.coalesce("size", F.lit((1 << 63) - 1)).alias("_last")).where("lack <> 0")
        if now.isEmpty():
            break
        fits = rounded.join(now, "_s").where((F.col("size") < F.col("_last")) & (F.col("size") <= F.abs("lack"))).withColumn("_room", room).where("_room > 0")
        best = fits.groupBy("_s").agg(F.first("lack").alias("lack"), F.max("size").alias("size"), F.max_by("_room", "size").alias("_room"))
        k = F.least(F.col("_room"), F.expr("abs(lack) div size")) * F.signum("lack").cast("long")
        picks.append(stored(best.withColumn("k", k).select("_s", (F.col("lack") - F.col("k") * F.col("size")).alias("lack"), "size", "k"), "mix-lack"))
    changes = union_all([p.where("k <> 0").select("_s", "size", "k") for p in picks])
    return rounded.join(changes, ["_s", "size"], "left").select("_s", "size", "n", (F.col("m") + F.coalesce("k", F.lit(0))).alias("m"))


def _with_copies(rows: DataFrame, weights, most: int, *carried) -> DataFrame:
    """rows (doc_id, _s, size, _b, ...) with source_size, target and copies."""
    parts = stored(rows.groupBy("_s", "size", "_b").agg(F.count("*").alias("c")), "mix-parts")
    cells = stored(parts.groupBy("_s", "size").agg(F.sum("c").alias("n")), "mix-cells")
    goals = stored(targets(cells, weights, most), "mix-targets")
    copies = cell_copies(cells, multipliers(cells, goals, most), most)
    before = Window.partitionBy("_s", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over buckets
    spread = parts.join(copies, ["_s", "size"], "left").withColumn("_c0", F.coalesce(F.sum("c").over(before), F.lit(0)))
    more = "CAST((CAST({0} AS DECIMAL(19, 0)) * (m % n)) div n AS BIGINT)"
    quota = F.expr(f"{more.format('_c0 + c')} - {more.format('_c0')}")
    quotas = spread.select("_s", "size", "_b", F.coalesce(F.expr("m div n"), F.lit(0)).alias("_each"), F.coalesce(quota, F.lit(0)).alias("_more"))
    quotas = stored(quotas.join(goals.select("_s", "source_size", "target"), "_s"), "mix-quotas")
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_b").orderBy(F.xxhash64("doc_id"), "doc_id"))
    placed = rows.join(quotas, ["_s", "size", "_b"]).withColumn("copies", F.col("_each") + F.when(rank <= F.col("_more"), 1).otherwise(0))
    return placed.select("doc_id", "size", "source_size", "target", "copies", *carried)


def shares(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: what the mix takes of each document, in copies and in words."""
    return _with_copies(stored(sized(docs), "mix-sizes"), weights, most).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken. Whole rows are shuffled once, by source and size."""
    found = _with_copies(sized(docs, F.struct(*docs.columns).alias("_own")), weights, most, "_own").where("copies > 0")
    return found.select("_own", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_own.*")
