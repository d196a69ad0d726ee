"""Statistics of two extractors' words and the choice between them. One aggregation row per page, then one CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.functions.folds import items
from pageforge.functions.text import strip, strip_sql


def stats(words: DataFrame) -> DataFrame:
    """Per page: counts, mean confidences, scores, share of confident words, variation of heights and confidences."""
    h = F.col("y2") - F.col("y1")
    found = words.groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.length(strip(F.col("text")))).alias("chars"), F.sum("ca").alias("sa"), F.sum("cb").alias("sb"),
        F.sum(F.col("ca") * F.col("ca")).alias("qa"), F.sum((F.col("cb") >= 50).cast("int")).alias("above_b"), F.sum(h).alias("sh"), F.sum(h * h).alias("qh"),
    )
    return _figures(found)


def page_stats(pages: DataFrame) -> DataFrame:
    """stats() of pages, with their other columns: the words of each are an array (o)."""
    h = "(w.y2 - w.y1)"
    value = {"chars": f"length({strip_sql('w.text')})", "sa": "w.ca", "sb": "w.cb", "qa": "w.ca * w.ca", "above_b": "CAST(w.cb >= 50 AS INT)", "sh": h, "qh": f"{h} * {h}"}
    sums = [F.expr(f"aggregate(o, 0L, (s, w) -> s + coalesce({v}, 0))").alias(k) for k, v in value.items()]
    own = [c for c in pages.columns if c != "page_id"]
    return _figures(pages.select("page_id", *own, F.size("o").cast("long").alias("n"), *sums), *own)


def _figures(found: DataFrame, *own: str) -> DataFrame:
    """The figures of sums of integers, which are divided once: the same on any partitioning."""
    cv = lambda s, q: f"CASE WHEN n < 2 OR {s} <= 0 THEN 0D ELSE sqrt(greatest(0D, CAST(n * {q} - {s} * {s} AS DOUBLE))) / {s} END"
    found = found.selectExpr(
        "page_id", *own, "n", "chars", "round(sa / (n * 100D), 9) AS avg_a", "round(sb / (n * 100D), 9) AS avg_b",
        "round(above_b / CAST(n AS DOUBLE), 9) AS ratio_b", f"round({cv('sh', 'qh')}, 9) AS height_cv", f"round({cv('sa', 'qa')}, 9) AS conf_cv",
    )
    return found.selectExpr("*", "avg_a * (1 + least(chars / 200D, 5D)) AS score_a", "avg_b * (1 + least(chars / 200D, 5D)) AS score_b")


def list_stats(words: str, name: str) -> list[str]:
    """The same figures as SQL over a page's array of words (text, conf 0..1, x1, y1, x2, y2), suffixed by name."""
    total = lambda value: f"aggregate({words}, 0D, (s, w) -> s + CAST({value} AS DOUBLE))"
    n, conf, height = f"size({words})", total("coalesce(w.conf, 0)"), total("w.y2 - w.y1")
    mean = f"coalesce({conf} / nullif({n}, 0), 0D)"
    chars = total(r"length(regexp_replace(w.text, '^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+\\z', ''))")
    def cv(value: str, s: str) -> str:
        spread = total(f"pow({value} - ({s}) / {n}, 2)")
        return f"CASE WHEN {n} < 2 OR {s} <= 0 THEN 0D ELSE sqrt({spread} / {n}) / ({s} / {n}) END"
    return [
        f"{n} AS n_{name}", f"{chars} AS chars_{name}", f"{mean} AS avg_{name}", f"{mean} * (1 + least({chars} / 200D, 5D)) AS score_{name}",
        f"coalesce({total('IF(w.conf >= 0.5D, 1, 0)')} / nullif({n}, 0), 0D) AS ratio_{name}",
        f"IF({n} >= 5, {cv('(w.y2 - w.y1)', height)}, 0D) AS height_cv_{name}", f"{cv('coalesce(w.conf, 0)', conf)} AS conf_cv_{name}",
    ]


#: The tables' thresholds and the names of their results. Rows are tried in order.
HANDWRITTEN = """CASE WHEN n = 0 THEN false
 WHEN chars >= 100 AND avg_a >= 0.78D THEN false
 WHEN chars >= 150 AND avg_a >= 0.72D THEN false
 WHEN n >= 8 AND height_cv > 0.35D AND avg_a < 0.70D THEN true
 WHEN n >= 10 AND conf_cv > 0.45D AND avg_a < 0.68D THEN true
 WHEN chars >= 30 AND avg_a < 0.72D AND edge >= 22.0D THEN true
 WHEN chars >= 15 AND avg_a < 0.60D AND edge >= 25.0D THEN true ELSE false END"""
ROUTE = """CASE WHEN handwritten THEN 'paddleocr(handwritten)'
 WHEN lower(trim(printed_engine)) = 'paddle' THEN 'paddleocr(printed)'
 WHEN avg_b < 0.20D THEN 'paddleocr(conf_low_fallback)'
 WHEN ratio_b < 0.40D AND avg_b < 0.45D THEN 'paddleocr(conf_weak_fallback)'
 WHEN score_b < 0.25D AND score_a > score_b + 0.20D THEN 'paddleocr(score_fallback)'
 WHEN score_b >= 0.85D * score_a AND avg_b >= 0.45D THEN 'tesseract(printed)'
 WHEN score_a > score_b + 0.25D THEN 'paddleocr(score_fallback)' ELSE 'tesseract(printed)' END"""


def decide(page_stats: DataFrame, printed_engine: str = "tesseract") -> DataFrame:
    """page_stats (with edge) with handwritten and engine_used; printed_engine, a name or a column of page_stats, is what
    printed pages are read with: "paddle" keeps the first recogniser's words, anything else tries the second one's."""
    found = page_stats if "printed_engine" in page_stats.columns else page_stats.withColumn("printed_engine", F.lit(printed_engine))
    found = found.withColumn("handwritten", F.expr(HANDWRITTEN)).withColumn("engine_used", F.expr(ROUTE))
    return found if "printed_engine" in page_stats.columns else found.drop("printed_engine")


def route(page_stats: DataFrame, edges: DataFrame, printed_engine: str = "tesseract") -> DataFrame:
    """page_stats with edge, handwritten and engine_used; edges is (page_id, edge)."""
    joined = page_stats.join(edges, "page_id", "left").withColumn("edge", F.coalesce("edge", F.lit(0.0)))
    return decide(joined, printed_engine)


def forced(engine, routed):
    """The engine that a caller asks for (a name, or a column of names), or else the routed one."""
    e = F.lower(strip(F.lit(engine) if isinstance(engine, str) else engine))
    return F.when(e == "paddle", F.lit("paddleocr(forced)")).when(e == "tesseract", F.lit("tesseract(forced)")).otherwise(routed)


def final_words(words: DataFrame, routes: DataFrame) -> DataFrame:
    """The words of the chosen extractor, with its confidence."""
    first = routes.select("page_id", F.startswith(F.col("engine_used"), F.lit("paddle")).alias("first"))
    conf = F.when(F.col("first"), F.col("ca")).otherwise(F.col("cb"))
    return words.join(first, "page_id").withColumn("conf", conf).drop("first", "ca", "cb")


def page_final_words(routed: DataFrame) -> DataFrame:
    """final_words() of routed pages, whose words are an array (o): nothing is joined."""
    first = F.startswith(F.col("engine_used"), F.lit("paddle")).alias("first")
    word = routed.select("page_id", first, F.explode(items("o")).alias("w")).select("page_id", "first", "w.*")
    return word.withColumn("conf", F.when(F.col("first"), F.col("ca")).otherwise(F.col("cb"))).drop("first", "ca", "cb")
