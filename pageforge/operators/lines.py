"""Words into reading-order lines, lines into pages and documents.

Pages are independent: every step is keyed by page_id, and a page's words are gathered once. The
line split is a fold against a running mean, which no window can say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.functions.folds import items, scan
from pageforge.functions.text import strip
from pageforge.operators import batches

#: A word joins the line while it is within the threshold of its running mean: the mean m of k words, the line's number.
_SAME = "a.k > 0 AND abs(w.yc - a.m) <= thr"
FOLD = scan(
    "o",
    {
        "m": ("double", "0D", f"IF({_SAME}, (a.m * a.k + w.yc) / (a.k + 1), w.yc)"),
        "k": ("int", "0", f"IF({_SAME}, a.k + 1, 1)"),
        "line": ("int", "-1", f"IF({_SAME}, a.line, a.line + 1)"),
    },
    f"IF({_SAME}, a.line, a.line + 1)", "int",
)


def place(pages: DataFrame) -> DataFrame:
    """pages (with o, the words as an array) with o sorted by vertical centre, as (yc, x1, seq, own), own being the word, and
    line, an array beside it: a word joins the line while it is within the threshold of its mean."""
    word = "struct(CAST((w.y1 + w.y2) / 2.0D AS DOUBLE) AS yc, w.x1 AS x1, w.seq AS seq, w AS own)"
    page = pages.withColumn("o", F.expr(f"array_sort(transform(o, w -> {word}))"))
    page = page.withColumn("h", F.expr("sort_array(transform(o, w -> greatest(1, w.own.y2 - w.own.y1)))"))
    page = page.withColumn("thr", F.expr("greatest(8D, 0.65D * h[CAST(size(h) div 2 AS INT)])"))
    return page.withColumn("line", F.expr(FOLD)).drop("h", "thr")


def gather(words: DataFrame) -> DataFrame:
    """Words as one row per page. They travel whole; pages that come from one row of their source need no such shuffle."""
    own = [c for c in words.columns if c != "page_id"]
    return words.groupBy("page_id").agg(F.collect_list(F.struct(*own)).alias("o"))


def group_lines(words: DataFrame) -> DataFrame:
    """words with line_no; one shuffle by page serves this and every step by page or line after it."""
    own = [c for c in words.columns if c != "page_id"]
    return grouped(gather(words), own)


def grouped(pages: DataFrame, own: list[str]) -> DataFrame:
    """The words of pages as rows, with line_no."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema["o"].dataType.elementType}
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "o").mapInArrow(batches.line_rows(own), f"page_id {kind}, {', '.join(f'{c} {kinds[c]}' for c in own)}, line_no int")


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id and lines, an array of what lines() has as rows (line_no, conf, box, n_words, line_text), of words with ca.
    Every step stays in the page's row: nothing is shuffled or sorted beyond a page."""
    return pages.select("page_id", "o").mapInArrow(batches.page_lines, f"page_id {pages.schema['page_id'].dataType.simpleString()}, lines {batches.LINES}")


def each_line(found: DataFrame) -> DataFrame:
    """Lines of page_lines() as rows."""
    return found.select("page_id", F.explode("lines").alias("l")).select("page_id", "l.*")


def joined_text(found: DataFrame) -> DataFrame:
    """page_text() of pages whose lines are an array."""
    return found.select("page_id", strip(F.array_join(F.transform("lines", lambda x: x["line_text"]), "\n")).alias("page_text"), F.size("lines").cast("long").alias("n_lines"))


def lines(grouped: DataFrame, conf: str = "ca") -> DataFrame:
    """One row per line: text in (x1, y1) order, mean confidence, box, number of words; blank lines go."""
    yc = ((F.col("y1") + F.col("y2")) / 2.0).alias("yc")
    order = F.array_sort(F.collect_list(F.struct("x1", "y1", yc, "seq", strip(F.col("text")).alias("t"))))
    mean = F.round(F.sum(F.coalesce(conf, F.lit(0))) / (F.count("*") * 100.0), 6)
    box = F.min("x1").alias("bx1"), F.min("y1").alias("by1"), F.max("x2").alias("bx2"), F.max("y2").alias("by2")
    return (
        grouped.groupBy("page_id", "line_no").agg(order.alias("o"), mean.alias("conf"), *box, F.count("*").alias("n_words"))
        .withColumn("line_text", strip(F.array_join(F.transform("o", lambda s: s["t"]), " "))).where("line_text <> ''").drop("o")
    )


def page_text(found: DataFrame) -> DataFrame:
    """One row per page: its lines' texts, one under the other."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_text"))), lambda s: s["line_text"])
    page = found.groupBy("page_id").agg(F.array_join(texts, "\n").alias("t"), F.count("*").alias("n_lines"))
    return page.select("page_id", strip(F.col("t")).alias("page_text"), "n_lines")


def flatten(pages: DataFrame) -> DataFrame:
    """page_id, line_no, word_no, text, bbox, w_px, h_px: the words of pages' nested lines, in order; a line without words
    stands for one, and a missing or zero size is 1920 by 1080."""
    sizes = (("width", 1920, "w_px"), ("height", 1080, "h_px"))
    size = [F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(default)).alias(o) for c, default, o in sizes]
    line = pages.select("page_id", *size, F.posexplode(items("lines")).alias("line_no", "l"))
    words = F.expr(
        "IF(size(coalesce(l.words, array())) = 0, array(struct(l.text AS text, l.bbox AS bbox)), "
        "transform(l.words, w -> struct(w.text AS text, w.bbox AS bbox)))"
    )
    word = line.select("page_id", "line_no", "w_px", "h_px", F.posexplode(words).alias("word_no", "w"))
    return word.select("page_id", "line_no", "word_no", "w.text", "w.bbox", "w_px", "h_px")
