"""The whole plan: files into one response row per document.

Reading, the first recogniser, the decision about the second one, and the second one are a single pass without a
shuffle; what they find, without the images, is written once to the folder of spark.checkpoint.dir, so that no
recogniser runs twice. Words are then shuffled by page for lines and zones, and pages by document.

Defined results: a page without words has an empty text and a bare page tag; a file that can't be read has no pages, an
error, and a bare body tag; a recogniser that fails on a page leaves its error there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageforge.functions import text
from pageforge.operators import extract, lines, routing, zones
from pageforge.sources import documents
from pageforge.sources.documents import Readers, WordExtractor
from pageforge.storage import stored

WORDS = "array<struct<text:string,conf:double,x1:int,y1:int,x2:int,y2:int>>"
_WORD = pa.list_(pa.struct([("text", pa.string()), ("conf", pa.float64()), *[(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]]))
NONE = f"CAST(array() AS {WORDS})"


@dataclass
class Recognised:
    """What the first recogniser finds in an image: the frame of the boxes, the edge level (see operators.images), the
    preset that it used, its words, and the image that the second one should see (None: the one given)."""

    width: int
    height: int
    words: list[tuple[str, float, int, int, int, int]] = field(default_factory=list)
    edge: float = 0.0
    preset: str = "clean_doc"
    image: bytes | None = None


Recogniser = Callable[[bytes, str], Recognised]


def _listed(words) -> list[dict]:
    return [dict(zip(("text", "conf", "x1", "y1", "x2", "y2"), w)) for w in words]


def score(words: list[tuple]) -> float:
    """Mean confidence, raised by up to five times with the number of characters; what routing calls score."""
    chars = sum(len(w[0].strip()) for w in words)
    return sum(w[1] or 0.0 for w in words) / max(1, len(words)) * (1 + min(chars / 200, 5))


def _first(recogniser: Recogniser, presets: list[str]):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                doc, page, native, image, error = (b.column(i)[k].as_py() for i in range(5))
                found = None
                if image is not None:
                    try:
                        found = max((recogniser(image, p) for p in presets), key=lambda f: score(f.words))
                        image = found.image or image
                    except Exception as e:  # noqa: BLE001  one bad page is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                f = found or Recognised(0, 0, preset="")
                row = (doc, page, native, image if found else None, error, f.width, f.height, f.edge, f.preset if found else None, _listed(f.words))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), _WORD)
                names = ["doc", "page_index", "native_text", "image", "error", "width", "height", "edge", "preset_used", "a"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    return run


def _second(extractor: WordExtractor, at: int):
    def run(batches):
        for b in batches:
            found, errors = [], []
            for image in b.column(at):
                words, error = [], None
                if image.is_valid:
                    try:
                        words = extractor(image.as_py())
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                found.append(_listed(words))
                errors.append(error)
            kept = [i for i in range(b.num_columns) if i != at]
            columns = [*(b.column(i) for i in kept), pa.array(found, _WORD), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(b.schema.names[i] for i in kept), "b", "error_b"])

    return run


def recognise(
    sources: DataFrame, first: Recogniser, second: WordExtractor, preset: str | list[str] = "auto", engine: str = "auto", printed_engine: str = "tesseract",
) -> DataFrame:
    """doc, page_index, native_text, error, width, height, preset_used, engine_used, words, score: one row per page.

    The second recogniser sees only pages that the first one's words don't settle, and none or all if one is forced; none
    too if printed pages stay with the first one. Of several presets, the one whose words score best is taken, the first
    of equal ones.
    """
    presets = [preset] if isinstance(preset, str) else list(preset)
    asked = ["clean_doc" if p == "auto" else documents.options(preset=p)["preset"] for p in presets]
    wanted = engine.strip().lower()
    page = sources.select("doc", "page_index", "native_text", "image", "error").mapInArrow(
        _first(first, asked),
        "doc string, page_index int, native_text string, image binary, error string, width int, height int, edge double, "
        f"preset_used string, a {WORDS}",
    )
    page = page.selectExpr("*", *routing.list_stats("a", "a")).withColumnsRenamed({"n_a": "n", "chars_a": "chars", "height_cv_a": "height_cv", "conf_cv_a": "conf_cv"})
    hand = F.expr(routing.HANDWRITTEN)
    stays = wanted == "paddle" or (wanted != "tesseract" and printed_engine.strip().lower() == "paddle")
    needed = F.lit(not stays) if stays or wanted == "tesseract" else ~hand
    page = page.select(
        "doc", "page_index", "native_text", "error", "width", "height", "preset_used", "a", "avg_a", "score_a", hand.alias("handwritten"),
        F.when(needed, F.col("image")).alias("image"), F.col("image").isNotNull().alias("seen"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in page.schema.fields if f.name != "image")
    page = page.mapInArrow(_second(second, page.columns.index("image")), f"{kept}, b {WORDS}, error_b string")
    page = page.selectExpr("*", *routing.list_stats("b", "b"))
    page = page.withColumn("printed_engine", F.lit(printed_engine))
    engine_used = F.when(F.col("seen"), routing.forced(engine, F.expr(routing.ROUTE)))
    page = page.withColumn("engine_used", engine_used).withColumn("_own", F.coalesce(F.startswith("engine_used", F.lit("paddle")), F.lit(True)))
    return page.select(
        "doc", "page_index", "native_text", F.coalesce("error", "error_b").alias("error"), "width", "height", "preset_used", "engine_used",
        F.when(F.col("_own"), F.col("a")).otherwise(F.col("b")).alias("words"), F.when(F.col("_own"), F.col("score_a")).otherwise(F.col("score_b")).alias("score"),
    )


def fix_words(words: DataFrame, dictionary: DataFrame | None = None, gate=extract.spell_gate) -> DataFrame:
    """words with text repaired: letters and digits parted, tokens that pass the gate spelled by the dictionary (term,
    freq), product names mended; words that become empty go."""
    parted = words.withColumn("text", text.split_letters_digits(F.coalesce("text", F.lit(""))))
    if dictionary is not None:
        token = parted.select("page_id", "seq", F.posexplode(F.expr(r"regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+', 0)")).alias("k", "token"))
        repaired = extract.repair(token.where(gate(F.col("token"))).select("token"), dictionary)
        own = F.array_sort(F.collect_list(F.struct("k", F.coalesce("repaired", "token").alias("t")))).alias("o")
        spelled = token.join(repaired, "token", "left").groupBy("page_id", "seq").agg(own)
        parted = parted.drop("text").join(spelled.select("page_id", "seq", F.array_join(F.transform("o", lambda s: s["t"]), "").alias("text")), ["page_id", "seq"])
    return parted.withColumn("text", text.brand_fix(text.strip(F.col("text")))).where("text <> ''")


def fallback_body(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """doc, body of documents (doc, text) that have no pages: their lines that aren't blank, mended, under a body tag."""
    line = docs.select(F.col("doc").alias("page_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    fixed = fix_words(line.where(text.strip(F.col("text")) != ""), dictionary)
    each = F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("o")
    body = fixed.groupBy(F.col("page_id").alias("doc")).agg(each)
    body = body.select("doc", F.concat(F.lit("<BODY>"), F.array_join(F.transform("o", lambda x: F.concat(F.lit("\n  "), x["text"])), "")).alias("body"))
    return docs.select("doc").join(body, "doc", "left").select("doc", F.coalesce("body", F.lit("<BODY>")).alias("body"))


def nested_lines(grouped: DataFrame) -> DataFrame:
    """Per page (page_id): lines with text, mean confidence, box and words; page_text."""
    yc = ((F.col("y1") + F.col("y2")) / 2.0).alias("yc")
    by_line = grouped.groupBy("page_id", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("x1", "y1", yc, "seq", text.strip(F.col("text")).alias("t")))).alias("o"),
        F.array_sort(F.collect_list(F.struct("x1", yc, "seq", "text", "conf", F.array("x1", "y1", "x2", "y2").alias("bbox")))).alias("w"),
        F.array(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).alias("bbox"),
    )
    # the mean in the words' order, so that it is the same on any partitioning
    by_line = by_line.withColumn("conf", F.expr("aggregate(w, 0D, (s, x) -> s + coalesce(x.conf, 0D)) / size(w)"))
    by_line = by_line.withColumn("text", text.strip(F.array_join(F.transform("o", lambda s: s["t"]), " "))).where("text <> ''")
    words = F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf"), x["bbox"].alias("bbox"))).alias("words")
    page = by_line.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.struct("text", "conf", "bbox", words).alias("line")))).alias("l"))
    page = page.select("page_id", F.transform("l", lambda x: x["line"]).alias("lines"))
    return page.withColumn("page_text", text.strip(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")))


def layout(grouped: DataFrame, pages: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """page_id, block: the tagged zones of each page that has words."""
    order = Window.partitionBy("page_id").orderBy("line_no", "x1", (F.col("y1") + F.col("y2")) / 2.0, "seq")
    placed = grouped.withColumn("seq", F.row_number().over(order)).join(pages, "page_id")
    return zones.zone_blocks(zones.zone_rows(zones.classify(fix_words(placed, dictionary))))


def respond(pages: DataFrame, found: DataFrame, echo: dict, dictionary: DataFrame | None = None, native_text_body: bool = False) -> DataFrame:
    """filename, formatted_text, raw_json (meta, text, pages, debug), error: one row per document.

    pages is what recognise gives; found has doc and input_type. native_text_body puts native text of pages without
    words under a body tag, which otherwise shows in raw_json only.
    """
    keyed = pages.withColumn("page_id", F.struct("doc", "page_index"))
    flat = keyed.select("page_id", F.posexplode("words").alias("seq", "w")).select("page_id", "seq", "w.*").withColumn("text", F.coalesce("text", F.lit("")))
    grouped = lines.group_lines(flat)
    size = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(other))
    blocks = layout(grouped, keyed.select("page_id", size("width", 1920).alias("w_px"), size("height", 1080).alias("h_px")), dictionary)
    page = keyed.join(nested_lines(grouped), "page_id", "left").join(blocks, "page_id", "left").join(found.select("doc", "input_type"), "doc")
    native, ocr = F.coalesce("native_text", F.lit("")), F.coalesce("page_text", F.lit(""))
    joined = F.when(native == "", ocr).when(F.col("engine_used").isNull(), native).otherwise(text.strip(F.concat(native, F.lit("\n"), ocr)))
    digital = (F.col("input_type") == "pdf") & F.col("native_text").isNotNull()
    none = F.expr("CAST(array() AS array<struct<text:string,conf:double,bbox:array<int>,words:array<struct<text:string,conf:double,bbox:array<int>>>>>)")
    own = F.struct("page_index", "width", "height", joined.alias("text"), F.coalesce("lines", none).alias("lines"))
    under = F.concat(F.lit("<BODY>\n  "), F.replace(F.col("native_text"), F.lit("\n"), F.lit("\n  ")))
    body = F.coalesce("block", under if native_text_body else F.lit(None).cast("string"))
    native_body = F.when(native != "", body).otherwise(F.col("block")) if native_text_body else F.col("block")
    counts = F.size("words").alias("words_count"), F.coalesce(F.size("lines"), F.lit(0)).alias("lines_count")
    debug = F.struct("page_index", "preset_used", "engine_used", *counts, "score")
    seen = F.when(F.col("engine_used").isNotNull(), F.col("page_index"))
    in_order = lambda when, value: F.array_sort(F.collect_list(F.when(when, value)))
    real = F.col("error").isNull() | F.col("engine_used").isNotNull()
    whole = page.groupBy("doc").agg(
        F.first("input_type").alias("input_type"), in_order(real, own).alias("p"),
        in_order(real, F.struct("page_index", native_body.alias("block"))).alias("b"),
        in_order(F.col("engine_used").isNotNull(), debug).alias("debug"), F.bool_or(digital).alias("digital"),
        F.min_by("engine_used", seen).alias("engine_used"), F.max_by("preset_used", seen).alias("preset_used"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_index"))).alias("error"),
    )
    office = F.col("input_type").isin("docx", "pptx")
    meta = F.struct(
        *[F.lit(v).alias(k) for k, v in echo.items()], "input_type", F.when(F.col("input_type") == "pdf", F.col("digital")).alias("digital_pdf"),
        F.when(office, F.coalesce("preset_used", F.lit("auto"))).otherwise(F.col("preset_used")).alias("preset_used"),
        F.when(~((F.col("input_type") == "pdf") & F.col("digital")), F.coalesce("engine_used", F.lit(""))).alias("engine_used"),
    )
    total = text.normalize_linebreaks(text.strip(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")))
    tidy = F.transform("p", lambda x: x.withField("text", F.when(F.col("digital"), x["text"]).otherwise(text.normalize_linebreaks(x["text"]))))
    block = lambda x: F.coalesce(F.concat(F.lit("\n"), x["block"]), F.lit(""))
    tag = lambda x, k: F.concat(F.lit("\n<PAGE "), (k + 1).cast("string"), F.lit(">"), block(x))
    tagged = F.when(F.size("b") == 0, F.lit("<BODY>")).otherwise(F.array_join(F.transform("b", tag), "\n"))
    more = [F.col("debug")] if echo["return_debug"] else []
    return whole.select(
        F.regexp_extract("doc", "([^/]*)$", 1).alias("filename"), tagged.alias("formatted_text"),
        F.struct(meta.alias("meta"), total.alias("text"), tidy.alias("pages"), *more).alias("raw_json"), "error", F.col("doc").alias("path"),
    )


def analyze(
    spark: SparkSession, path: str | list[str], first: Recogniser, second: WordExtractor, readers: Readers = Readers(), dictionary: DataFrame | None = None,
    preset: str | list[str] = "auto", dpi: int = 150, max_pages: int = 5, engine: str = "auto", return_layout: bool = True, return_debug: bool = True,
    native_text_body: bool = False, printed_engine: str = "tesseract",
) -> DataFrame:
    """One response row per file of an allowed type under path; any number of files. Of several presets, the best one's
    words count, page by page."""
    documents.options(dpi, max_pages)
    found = documents.files(spark, path, "path")
    pages = stored(recognise(documents.page_sources(found, max_pages, dpi, readers), first, second, preset, engine, printed_engine), "recognised")
    # fixed values: the names and constants that a response echoes
    echo = {
        "engine": "auto(paddle+tesseract)", "lang": "en", "preset_requested": preset if isinstance(preset, str) else ",".join(preset), "dpi": dpi,
        "max_pages": max_pages, "mkldnn_disabled": True, "engine_requested": engine, "return_layout": return_layout, "return_debug": return_debug,
    }
    return respond(pages, found, echo, dictionary, native_text_body)


def envelope(responses: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row: count and results, in the order given (names or paths, as they were handed in; others after them), then
    by path. More than MAX_FILES responses are an error; no more than one above that is ever gathered."""
    place = F.lit(len(order or []))
    for k in reversed(range(len(order or []))):
        place = F.when(F.endswith(F.concat(F.lit("/"), F.col("path")), F.lit("/" + order[k].lstrip("/"))), F.lit(k)).otherwise(place)
    few = responses.limit(documents.MAX_FILES + 1)
    row = few.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(place.alias("place"), "path", "filename", "formatted_text", "raw_json"))).alias("r"))
    fits = F.when(F.col("count") > documents.MAX_FILES, F.raise_error(F.lit(f"at most {documents.MAX_FILES} responses fit one row"))).otherwise(F.col("count"))
    result = F.transform("r", lambda x: F.struct(x["filename"].alias("filename"), x["formatted_text"].alias("formatted_text"), x["raw_json"].alias("raw_json")))
    return row.select(fits.cast("long").alias("count"), result.alias("results"))
