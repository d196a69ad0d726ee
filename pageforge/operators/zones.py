"""Page zones: the sidebar gutter, zone classes, visual rows, tagged text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageforge.functions.folds import items, scan
from pageforge.functions.text import strip
from pageforge.operators import batches

BAND = "filter(o, w -> (w.y1 + w.y2) / 2D > 0.15D * h_px AND (w.y1 + w.y2) / 2D < 0.85D * h_px)"
#: Stretches of the pixel columns lo to hi that words of the band cover, by their starts.
COVER = "array_sort(transform(filter(band, w -> w.x2 > w.x1 AND w.x1 < hi AND w.x2 > lo), w -> struct(greatest(w.x1, lo) AS a, least(w.x2, hi) AS b)))"
#: The widest stretch that is not covered, the first of several: p is how far the cover reaches, n and s its length and start.
GAP = f"""aggregate(concat({COVER}, array(struct(hi AS a, hi AS b))), named_struct('p', lo, 'n', 0, 's', lo),
 (g, c) -> named_struct('p', greatest(g.p, c.b), 'n', greatest(g.n, c.a - g.p), 's', IF(c.a - g.p > g.n, g.p, g.s)))"""


def gather(words: DataFrame) -> DataFrame:
    """Words as one row per page: w_px, h_px, and the words as an array (o)."""
    own = [c for c in words.columns if c not in ("page_id", "w_px", "h_px")]
    return words.groupBy("page_id").agg(F.max("w_px").alias("w_px"), F.max("h_px").alias("h_px"), F.collect_list(F.struct(*own)).alias("o"))


def measured(pages: DataFrame) -> DataFrame:
    """Pages (page_id, w_px, h_px, o) with median_h and sidebar."""
    page = pages.withColumn("h", F.expr("sort_array(transform(o, w -> w.y2 - w.y1))")).withColumn("band", F.expr(BAND))
    page = page.withColumn("lo", F.expr("CAST(w_px * 0.10D AS INT)")).withColumn("hi", F.expr("CAST(w_px * 0.25D AS INT)"))
    page = page.withColumn("gap", F.expr(f"CASE WHEN w_px > 1.1D * h_px AND size(band) > 0 THEN {GAP} END"))
    return page.select(
        "page_id", "w_px", "h_px", "o", F.expr("(h[CAST((size(h) - 1) div 2 AS INT)] + h[CAST(size(h) div 2 AS INT)]) / 2D").alias("median_h"),
        F.expr("CASE WHEN gap.n > 0.02D * w_px THEN least(gap.s + gap.n / 2D, 0.22D * w_px) ELSE -1D END").alias("sidebar"),
    )


def geometry(words: DataFrame) -> DataFrame:
    """Per page: median_h, sidebar (the gutter's middle, or -1): the widest run of pixel columns between 0.10 and 0.25 of the
    width that no word of the middle band covers, on landscape pages, if it is wider than 0.02 of the width."""
    return measured(gather(words)).drop("o")


def gutter(words: DataFrame) -> DataFrame:
    """The same as geometry(), page by page or not: words of any number on a page stay rows. What words cover between the
    two columns is cut to intervals; a running maximum over their starts tells how far the cover reaches before each."""
    middle = "w_px > 1.1D * h_px AND (y1 + y2) / 2D > 0.15D * h_px AND (y1 + y2) / 2D < 0.85D * h_px"
    lo, hi = F.expr("CAST(w_px * 0.10D AS INT)"), F.expr("CAST(w_px * 0.25D AS INT)")
    # a page's figures come from its heights and how often each occurs; the median's two lie at (n - 1) / 2 and n / 2
    counts = F.count("h").alias("k"), F.expr(f"count_if({middle})").alias("band")
    size = F.max("w_px").alias("w_px"), F.max("h_px").alias("h_px")
    many, each = words.withColumn("h", F.expr("y2 - y1")).groupBy("page_id", "h").agg(*size, *counts), Window.partitionBy("page_id")
    many = many.withColumn("n", F.sum("k").over(each)).withColumn("upto", F.sum("k").over(each.orderBy("h")))
    at = "min(CASE WHEN upto > {} div 2 THEN h END)"
    median = F.expr(f"({at.format('(n - 1)')} + {at.format('n')}) / 2D").alias("median_h")
    page = many.groupBy("page_id").agg(*size, median, F.sum("band").alias("band"))
    # a page's size is on each of its words, so the cover needs no join
    band = words.where(middle).select("page_id", lo.alias("lo"), hi.alias("hi"), "x1", "x2")
    cover = band.where("x2 > x1 AND x1 < hi AND x2 > lo").selectExpr("page_id", "lo", "greatest(x1, lo) AS a", "least(x2, hi) AS b")
    reach = F.max("b").over(Window.partitionBy("page_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    gaps = cover.withColumn("s", F.greatest("lo", F.coalesce(reach, F.col("lo"))))
    widest = gaps.groupBy("page_id").agg(F.max(F.struct((F.col("a") - F.col("s")).alias("n"), (-F.col("s")).alias("s"))).alias("g"), F.max("b").alias("reach"))
    # the last gap is from the end of all cover to the right column
    found = page.join(widest, "page_id", "left").withColumn("s", F.greatest(lo, F.coalesce("reach", lo)))
    last = F.expr("IF(band > 0, named_struct('n', CAST(w_px * 0.25D AS INT) - s, 's', -s), NULL)")
    found = found.withColumn("g", F.greatest("g", last))
    center = F.expr("CASE WHEN g.n > 0.02D * w_px THEN least(g.n / 2D - g.s, 0.22D * w_px) ELSE -1D END")
    return found.select("page_id", "median_h", center.alias("sidebar"))


#: Where zones begin and end.
ZONE = """CASE WHEN (y1 + y2) / 2D < 0.12D * h_px THEN 'HEADER' WHEN (y1 + y2) / 2D > 0.92D * h_px THEN 'FOOTER'
 WHEN sidebar <> -1 AND (x1 + x2) / 2D < sidebar THEN 'SIDEBAR' ELSE 'BODY' END"""
#: A row goes on while words are close to its first one, at y; r is its number.
_SAME = "a.r >= 0 AND abs(w.yc - a.y) < 0.65D * median_h"
ROWS = scan(
    "o", {"y": ("double", "0D", f"IF({_SAME}, a.y, w.yc)"), "r": ("int", "-1", f"IF({_SAME}, a.r, a.r + 1)")},
    f"IF({_SAME}, a.r, a.r + 1)", "int",
)


def classify(words: DataFrame) -> DataFrame:
    """words with median_h, sidebar and zone; one shuffle by page, which the steps after it share."""
    own = [c for c in words.columns if c not in ("page_id", "w_px", "h_px")]
    return classified(measured(gather(words)), own)


def classified(found: DataFrame, own: list[str]) -> DataFrame:
    """The words of measured pages as rows, with zone."""
    word = found.select("page_id", "w_px", "h_px", "median_h", "sidebar", F.explode(items("o")).alias("w"))
    return word.select("page_id", *[F.col("w")[c].alias(c) for c in own], "w_px", "h_px", "median_h", "sidebar").withColumn("zone", F.expr(ZONE))


def page_geometry(pages: DataFrame) -> DataFrame:
    """geometry() of pages."""
    return pages.select("page_id", "w_px", "h_px", "o").mapInArrow(batches.page_geometry, f"{_id(pages)}, median_h double, sidebar double")


def page_zones(pages: DataFrame) -> DataFrame:
    """page_id, seq, zone of the words of pages."""
    return pages.select("page_id", "w_px", "h_px", "o").mapInArrow(batches.zone_words(["seq"]), f"{_id(pages)}, seq int, zone string")


def page_rows(pages: DataFrame) -> DataFrame:
    """zone_rows() of pages. Nothing is shuffled or sorted beyond a page."""
    return pages.select("page_id", "w_px", "h_px", "o").mapInArrow(batches.zone_rows, f"{_id(pages)}, zone string, row_no int, row_text string")


def page_tagged(pages: DataFrame) -> DataFrame:
    """tagged_text() of pages."""
    return pages.select("page_id", "w_px", "h_px", "o").mapInArrow(batches.tagged_text, f"{_id(pages)}, tagged string")


def _id(pages: DataFrame) -> str:
    return f"page_id {pages.schema['page_id'].dataType.simpleString()}"


def zone_rows(zoned: DataFrame) -> DataFrame:
    """page_id, zone, row_no, row_text: a row goes on while words are close to its first one; wide gaps in the body get a bar."""
    yc = ((F.col("y1") + F.col("y2")) / 2.0).cast("double").alias("yc")
    own = F.array_sort(F.collect_list(F.struct(yc, "seq", "x1", "x2", "text"))).alias("o")
    page = zoned.groupBy("page_id", "zone").agg(F.first("median_h").alias("median_h"), F.first("w_px").alias("w_px"), own)
    word = page.select("page_id", "zone", "w_px", F.explode(F.arrays_zip("o", F.expr(ROWS).alias("r"))).alias("z"))
    word = word.selectExpr("page_id", "zone", "w_px", "z.r AS row_no", "z.o.*")
    along = Window.partitionBy("page_id", "zone", "row_no").orderBy("x1", "yc", "seq")
    word = word.withColumn("gap", F.col("x1") - F.lag("x2").over(along))
    word = word.withColumn("part", F.expr("concat(CASE WHEN gap IS NULL THEN '' WHEN zone = 'BODY' AND gap > 0.035D * w_px THEN '   |   ' ELSE ' ' END, text)"))
    rows = word.groupBy("page_id", "zone", "row_no").agg(F.array_sort(F.collect_list(F.struct("x1", "yc", "seq", "part"))).alias("o"))
    return rows.select("page_id", "zone", "row_no", strip(F.array_join(F.transform("o", lambda s: s["part"]), "")).alias("row_text"))


def zone_blocks(rows: DataFrame) -> DataFrame:
    """page_id, block: the page's zones in fixed order, each row indented under its zone's tag."""
    rank = F.expr("CASE zone WHEN 'HEADER' THEN 0 WHEN 'SIDEBAR' THEN 1 WHEN 'BODY' THEN 2 ELSE 3 END")
    zones = rows.groupBy("page_id", "zone").agg(F.array_sort(F.collect_list(F.struct("row_no", "row_text"))).alias("o"))
    zones = zones.select("page_id", rank.alias("k"), F.concat(F.lit("<"), F.col("zone"), F.lit(">\n"), F.array_join(F.transform("o", lambda s: F.concat(F.lit("  "), s["row_text"])), "\n")).alias("block"))
    return zones.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "block"))).alias("o")).select("page_id", F.array_join(F.transform("o", lambda s: s["block"]), "\n").alias("block"))


def tagged_text(rows: DataFrame) -> DataFrame:
    """page_id, tagged: each page as the first one of its document."""
    return zone_blocks(rows).select("page_id", F.concat(F.lit("\n<PAGE 1>\n"), F.col("block")).alias("tagged"))
