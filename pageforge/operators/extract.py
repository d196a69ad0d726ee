"""Rows of text extractors: boxes, confidences, dispatch by file name; spelling repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pageforge.functions.folds import runs
from pageforge.functions.text import strip, suffix
from pageforge.operators import spelling
from pageforge.storage import stored

#: The suffixes that are taken.
ALLOWED = ("pdf", "doc", "docx", "ppt", "pptx", "jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif", "gif")


#: Letters of a long word from which delete keys are made; letters up to which keys hold places; terms of a key that
#: meet their tokens in one task.
PREFIX, SHORT, BUCKET = 12, 6, 2000


def dispatch(named: DataFrame) -> DataFrame:
    """named (with filename) and suffix, allowed, input_type."""
    s = suffix(F.col("filename"))
    kind = F.when(s.isin(".pdf", ".doc", ".ppt"), "pdf").when(s == ".docx", "docx").when(s == ".pptx", "pptx").otherwise("image")
    return named.withColumn("suffix", s).withColumn("allowed", s.isin(*[f".{x}" for x in ALLOWED])).withColumn("input_type", kind)


def boxes(polygons: DataFrame) -> DataFrame:
    """polygons (with poly, an array of x, y) and their boxes, truncated to whole pixels."""
    cut = lambda f, c: f(F.transform("poly", lambda p: p[c])).cast("int")
    return polygons.withColumns({"bx1": cut(F.array_min, "x"), "by1": cut(F.array_min, "y"), "bx2": cut(F.array_max, "x"), "by2": cut(F.array_max, "y")}).drop("poly")


def normalize_rows(raw: DataFrame) -> DataFrame:
    """Raw recogniser rows (text, conf as text, left, top, width, height) into words; blank ones go, confidence is 0..1."""
    conf = F.expr("greatest(0D, least(1D, coalesce(try_cast(conf_raw AS DOUBLE), -1D) / 100))")
    kept = raw.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("conf", F.round(conf, 6))
    return kept.withColumns({"x2": F.col("x1") + F.col("width"), "y2": F.col("y1") + F.col("height")}).drop("conf_raw", "width", "height")


def single_char(raw: DataFrame, *keys: str) -> DataFrame:
    """Per key, of raw rows (seq, text, conf_raw): the first character of the joined text, and the mean of the valid confidences,
    0..1."""
    conf = F.expr("try_cast(conf_raw AS DOUBLE)")
    found = raw.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("t"),
        F.sum(F.when(conf >= 0, conf)).alias("s"), F.count_if(conf >= 0).alias("k"),
    )
    return _char(found, *keys)


def page_chars(pages: DataFrame, cell: str) -> DataFrame:
    """single_char() of pages' raw words (an array, o), by page_id and cell, SQL on a word w; nothing is shuffled."""
    found = pages.withColumn("o", F.expr(f"array_sort(transform(o, w -> struct({cell} AS cell, w.seq AS seq, coalesce(w.text, '') AS t, try_cast(w.conf_raw AS DOUBLE) AS c)))"))
    part = """struct(r[0].cell AS cell, array_join(transform(r, w -> w.t), '') AS t, aggregate(r, CAST(NULL AS DOUBLE), (a, w) -> IF(w.c >= 0, coalesce(a, 0D) + w.c, a)) AS s,
     CAST(size(filter(r, w -> w.c >= 0)) AS BIGINT) AS k)"""
    cells = found.withColumn("cells", F.expr("transform(o, w -> w.cell)")).select("page_id", F.explode(F.expr(runs("o", "cells", part))).alias("x"))
    return _char(cells.select("page_id", "x.*"), "page_id", "cell")


def _char(found: DataFrame, *keys: str) -> DataFrame:
    mean = F.coalesce(F.col("s") / F.nullif(F.col("k"), F.lit(0)), F.lit(0.0)) / 100
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 6)
    return found.select(*keys, F.left(strip(F.col("t")), F.lit(1)).alias("char"), clamped.alias("conf"))


def extractor_words(raw: DataFrame, result: str = "result") -> DataFrame:
    """raw without `result` (an extractor's result, as JSON) and, for each word in it, item (its place), text, conf, poly.

    A result is a list of items [polygon, [text, confidence]], or a list of one page that is such a list. Items that are
    empty, too short, or whose polygon or confidence can't be read, are left out; none of them fails its page.
    """
    def rows(json: str) -> str:
        return f"from_json({json}, 'array<string>')"

    page = rows("get(_top, 0)")
    first = rows(f"get({page}, 0)")
    inner = f"IF(size(_top) = 1 AND size(coalesce({first}, array())) >= 2, {page}, _top)"
    item = raw.withColumn("_top", F.expr(rows(result))).withColumn("_items", F.expr(inner)).drop(result, "_top")
    item = item.select("*", F.posexplode("_items").alias("item", "_item")).drop("_items").withColumn("_parts", F.expr(rows("_item")))
    item = item.where("size(_parts) >= 2").withColumn("poly", F.expr("from_json(get(_parts, 0), 'array<array<double>>')")).withColumn("_tc", F.expr(rows("get(_parts, 1)")))
    item = item.where("size(_tc) >= 2").withColumns({"text": F.expr("get(_tc, 0)"), "conf": F.expr("try_cast(get(_tc, 1) AS double)")})
    whole = "size(poly) > 0 AND forall(poly, p -> get(p, 0) IS NOT NULL AND get(p, 1) IS NOT NULL)"
    points = F.expr("transform(poly, p -> struct(p[0] AS x, p[1] AS y))")
    return item.where(f"coalesce({whole}, false) AND conf IS NOT NULL").withColumn("poly", points).drop("_item", "_parts", "_tc")


def best_of(candidates: DataFrame, *keys: str) -> DataFrame:
    """Per key, the candidate (with score, and place among the presets that were tried) that scores best, the first of
    equal ones."""
    own = [c for c in candidates.columns if c not in keys]
    best = F.max_by(F.struct(*own), F.struct("score", -F.col("place"))).alias("b")
    return candidates.groupBy(*keys).agg(best).select(*keys, "b.*")


def columnar(raw: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Parallel array columns into rows, each with its keys."""
    return raw.select(*keys, F.explode(F.arrays_zip(*names)).alias("r")).select(*keys, "r.*")


def spell_gate(token):
    """Lower-case words of letters, longer than three."""
    return (F.length(token) > 3) & (F.lower(token) == token) & token.rlike(r"^\p{L}+$") & (F.upper(token) != token)  # cheap ones first


def _swap(a: str, i: str) -> str:
    """The text a with its letters i and i + 1 changed over, as SQL."""
    return f"concat(substr({a}, 1, {i} - 1), substr({a}, {i} + 1, 1), substr({a}, {i}, 1), substr({a}, {i} + 2))"


def _one(a: str, b: str) -> str:
    """0, 1 or, for anything more, 9: edits between two short texts, where a swap of neighbours counts one."""
    return (
        f"CASE levenshtein({a}, {b}, 2) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN "
        f"IF(length({a}) = length({b}) AND exists(sequence(1, length({a}) - 1), q -> {_swap(a, 'q')} = {b}), 1, 9) ELSE 9 END"
    )


def edits(a: str, b: str, letters_a: str | None = None, letters_b: str | None = None) -> str:
    """0, 1, 2 or null, for more: insertions, deletions, substitutions and swaps of neighbours between a and b, none
    within another, as SQL. A swap is two plain edits, so what swaps can mend is at most four plain edits apart, and
    has the same letters but for one edit. These, sorted, can be given as columns of their own."""
    letters = lambda x: f"array_join(array_sort(split({x}, '')), '')"
    letters_a, letters_b = letters_a or letters(a), letters_b or letters(b)
    left, right = _one(f"substr({a}, 1, i - 1)", f"substr({b}, 1, j - 1)"), _one(f"substr({a}, i + 2)", f"substr({b}, j + 2)")
    crossed = f"substr({a}, i, 1) = substr({b}, j + 1, 1) AND substr({a}, i + 1, 1) = substr({b}, j, 1)"
    near = f"sequence(greatest(1, i - 1), greatest(1, least(length({b}) - 1, i + 1)))"
    more = f"exists(sequence(1, length({a}) - 1), i -> exists({near}, j -> {crossed} AND ({left}) + ({right}) <= 1))"
    return (
        f"CASE levenshtein({a}, {b}, 4) WHEN 0 THEN 0 WHEN 1 THEN 1 "
        f"WHEN 2 THEN IF(({_one(a, b)}) = 1, 1, 2) "
        f"WHEN 3 THEN IF(length({a}) > 1 AND levenshtein({letters_a}, {letters_b}, 2) BETWEEN 0 AND "
        f"2 - abs(length({a}) - length({b})) AND {more}, 2, NULL) "
        f"WHEN 4 THEN IF({letters_a} = {letters_b} AND {more}, 2, NULL) END"
    )


def _keyed(df: DataFrame, name: str, asked: bool, distance: int) -> DataFrame:
    """df, its sorted letters, and key, for each of its words' keys (see spelling.keyed)."""
    letters = F.array_join(F.array_sort(F.split(F.col(name), "")), "").alias("letters")
    found = df.where(F.col(name).isNotNull()).select("*", letters)
    keys = spelling.keyed(found.columns.index(name), asked, distance, PREFIX, SHORT)
    schema = StructType([*found.schema.fields, StructField("key", ArrayType(LongType(), False))])
    return found.mapInArrow(keys, schema).withColumn("key", F.explode("key"))


def _met(tokens: DataFrame, terms: DataFrame, tasks: int) -> DataFrame:
    """tokens and terms that share a key. A key of more than BUCKET terms is dealt over several: its terms in chunks, its
    tokens to each of them, so that no task has a whole one and no pair is lost. Keys are many more than the words by which
    Spark guesses their size, so it is told to merge: it would broadcast them."""
    terms = stored(terms, "spelling-keys")
    hot = stored(terms.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("_c")), "spelling-hot")
    if hot.isEmpty():
        met = tokens.repartition(tasks, "key").hint("merge").join(terms, "key")
    else:
        chunks = F.coalesce("_c", F.lit(1))
        dealt = terms.join(hot, "key", "left").withColumn("_k", F.pmod(F.xxhash64("term"), chunks).cast("int")).drop("_c")
        asked = tokens.join(hot, "key", "left").withColumn("_k", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_c")
        met = asked.repartition(tasks, "key", "_k").hint("merge").join(dealt, ["key", "_k"])
    return met


def repair(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, repaired) for distinct tokens: the closest term within two edits, then the more frequent, then the first.

    Terms stay as they are. The others are looked for one edit away, and only what has no term there two edits away.
    Candidates share a key (see spelling.place_keys), so this is an equi-join, by sorting; edits are
    counted on candidates only, in the join's own stage, and a candidate that is met twice does no harm to a minimum.
    """
    asked = tokens.select("token").distinct()
    known = stored(dictionary.groupBy("term").agg(F.max("freq").alias("freq")), "spelling-terms")
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not merged
    left = stored(asked.join(known.select(F.col("term").alias("token")), "token", "left_anti").repartition(tasks, "token"), "tokens-left")
    found = asked.join(left, "token", "left_anti").select("token", F.col("token").alias("repaired"))
    for distance in (1, 2):
        pairs = _met(_keyed(left, "token", True, distance).withColumnRenamed("letters", "la"), _keyed(known, "term", False, distance).withColumnRenamed("letters", "lb"), tasks)
        near = pairs.where(F.abs(F.length("token") - F.length("term")) <= distance)
        near = near.withColumn("d", F.expr(edits("token", "term", "la", "lb")))
        least = F.min(F.struct("d", (-F.col("freq")).alias("f"), "term")).alias("b")
        best = stored(near.where(f"d <= {distance}").groupBy("token").agg(least).select("token", F.col("b.term").alias("repaired")), "tokens-repaired")
        found, left = found.unionByName(best), left.join(best, "token", "left_anti")
    return found.unionByName(left.select("token", F.col("token").alias("repaired")))
