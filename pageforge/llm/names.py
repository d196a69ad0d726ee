"""Join of two tables by names that are a few edits apart, by symmetric deletion neighbourhoods.

Both sides are cut down to their distinct names first, so a name that a third of all rows has is one row. Every distinct
name gives all variants of itself with up to `most` code points left out; whatever an edit inserts, removes, replaces or
exchanges can be left out on both sides, so names within `most` edits share a variant. Variants are joined by their
hashes, pairs are told apart and counted once, and each pair's distance is computed exactly in a band of 2 * most + 1
diagonals. Pairs of distinct names go back to rows by equi-joins on names.

Distance: the fewest insertions, deletions or substitutions of one code point and exchanges of two adjacent ones, where
what was exchanged may be edited again (unrestricted Damerau-Levenshtein).

Defined results: null and empty names take no part; names are compared as they are, by code points; rows that share a
name share its pairs, and repeated rows each count; an empty side gives an empty result; a name may be of any length (its
variants grow with length to the power `most`, the verification with length); other columns are ignored. Joins are
shuffled on both sides whatever their size: nothing that grows is broadcast, collected or brought to one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.storage import stored

#: Ways in which rows of one name are dealt when they meet the name's pairs.
SALTS = 16


def within_edits(a: str, b: str, most: int) -> int | None:
    """The distance of a and b, or None where it is above `most`."""
    n, m, far = len(a), len(b), most + 1
    if abs(n - m) > most:
        return None
    width = 2 * most + 1
    # rows[i][j - i + most]: the distance of a[:i] and b[:j] in the band, `far` for anything more
    rows = [[min(far, j) if 0 <= (j := k - most) <= m else far for k in range(width)]]
    seen: dict[str, int] = {}  # the last place (from 1) so far of each of a's code points
    for i in range(1, n + 1):
        row, above, x = [far] * width, rows[-1], a[i - 1]
        for k in range(width):
            j = i + k - most
            if j < 0 or j > m:
                continue
            if j == 0:
                row[k] = min(far, i)
                continue
            y = b[j - 1]
            best = above[k] + (x != y)
            if k + 1 < width:
                best = min(best, above[k + 1] + 1)
            if k:
                best = min(best, row[k - 1] + 1)
            # exchange: x stands earlier in b, at q, and y earlier in a, at p; what lies between is removed or inserted
            p, q = seen.get(y, 0), b.rfind(x, max(0, j - 2 - most), j - 1) + 1
            if p and q and x != y:
                at = (q - 1) - (p - 1) + most
                if 0 <= at < width and i - p + j - q - 1 <= most:
                    best = min(best, rows[p - 1][at] + i - p + j - q - 1)
            row[k] = min(best, far)
        seen[x] = i
        rows.append(row)
    found = rows[n][m - n + most]
    return found if found <= most else None


def _verified(most: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            found = pa.array([within_edits(x, y, most) for x, y in zip(a, b)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["a", "b", "distance"]).filter(found.is_valid())

    return run


def distinct_names(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.length(name) > 0).select(F.col(name).alias("w")).distinct()


def variants(names: DataFrame, most: int) -> DataFrame:
    """(w, key): hashes of each name with up to `most` code points left out."""
    drop = "transform(sequence(1, length(v)), i -> concat(left(v, i - 1), substr(v, i + 1)))"
    found = names.withColumn("_all", F.array("w")).withColumn("_new", F.array("w"))
    for _ in range(most):
        found = found.withColumn("_new", F.expr(f"array_distinct(flatten(transform(filter(_new, v -> length(v) > 0), v -> {drop})))"))
        found = found.withColumn("_all", F.array_distinct(F.concat("_all", "_new")))
    return found.select("w", F.explode(F.transform("_all", lambda v: F.xxhash64(v))).alias("key"))


def similar_names(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """(a, b, distance): pairs of distinct names (w) of the two sides that are at most `most` edits apart."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda names, to: variants(names, most).withColumnRenamed("w", to).repartition(tasks, "key")
    met = dealt(left, "a").hint("shuffle_merge").join(dealt(right, "b").hint("shuffle_merge"), "key")
    near = met.where(F.abs(F.length("a") - F.length("b")) <= most).select("a", "b").repartition(tasks, "a", "b").distinct()
    return stored(near.mapInArrow(_verified(most), "a string, b string, distance int"), "name-pairs")


def join_counts(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """For each row of left (id, name) and each distance at which right (id, name) has names: id, distance, n (rows of
    right), first (their least id), crc (the sum of the unsigned crc32 of their ids' digits)."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = right.where(F.length("name") > 0).groupBy(F.col("name").alias("b")).agg(
        F.count("*").alias("_n"), F.min("id").alias("_first"), F.coalesce(F.sum(F.crc32(F.col("id").cast("string").cast("binary"))), F.lit(0)).alias("_crc")
    )
    of = stored(of, "names-right")
    rows = stored(left.where(F.length("name") > 0).select("id", F.col("name").alias("a")), "names-left")
    pairs = similar_names(distinct_names(rows, "a"), of.select(F.col("b").alias("w")), most)
    found = pairs.repartition(tasks, "b").hint("shuffle_merge").join(of.repartition(tasks, "b").hint("shuffle_merge"), "b")
    found = found.groupBy("a", "distance").agg(F.sum("_n").alias("n"), F.min("_first").alias("first"), F.sum("_crc").alias("crc"))
    # rows of one name are dealt over several tasks, each of which gets the few rows of the name's result
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(tasks, "a", "_salt")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).repartition(tasks, "a", "_salt")
    return salted.hint("shuffle_merge").join(found.hint("shuffle_merge"), ["a", "_salt"]).select("id", "distance", "n", "first", "crc")


def misspelt(name, number):
    """name with the code points at h mod (length - 1) and the next exchanged, where h, the unsigned crc32 of the number's
    digits, is even and the name has two at least."""
    h = F.crc32(number.cast("string").cast("binary"))
    at = F.pmod(h, F.greatest(F.length(name) - 1, F.lit(1))).cast("int")
    swapped = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2, F.lit(1)), F.substr(name, at + 1, F.lit(1)), F.substr(name, at + 3))
    return F.when((h % 2 == 0) & (F.length(name) >= 2), swapped).otherwise(name)
