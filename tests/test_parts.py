"""Parts of files that can't be read, shapes, dictionaries, batches, presets, long pages."""

import io
import time
import zipfile

import pytest

from pageforge.operators import lines, zones
from pageforge.plans.analyze import Recognised, analyze, envelope, score
from pageforge.sources import documents, readers
from pageforge.sources.documents import Readers, office_pages
from pageforge.storage import shared_dir
from tests_support import docx


def test_unreadable_pictures_do_not_count():
    content = docx(["one"], [], {"a.png": b"bad", "b.png": b"good1", "c.wmf": b"good", "d.png": b"good2", "e.png": b"good3"})
    rows = office_pages(".docx", content, 2, Readers(decodes=lambda data: data.startswith(b"good")))
    assert rows == [(0, "one", None), (1, None, b"good1"), (2, None, b"good2")]


def test_a_bad_part_leaves_the_rest():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<no xml")
        z.writestr("word/media/a.png", b"a")
    assert office_pages(".docx", out.getvalue(), 5) == [(0, "", None), (1, None, b"a")]


def test_text_by_shape():
    out, a = io.BytesIO(), 'xmlns:a="urn:a"'
    shape = lambda *texts: "<p:sp>" + "".join(f"<a:p {a}><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts) + "</p:sp>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<p:sld xmlns:p="urn:p">{shape(" one", "", "two ")}{shape("", " ")}{shape("three")}</p:sld>')
    assert office_pages(".pptx", out.getvalue(), 5) == [(0, "one\n\ntwo\nthree", None)]


def test_missing_libraries_are_named():
    with pytest.raises(RuntimeError, match="pdfplumber"):
        readers.pdf_text(b"", 1)
    with pytest.raises(RuntimeError, match="fitz"):
        readers.pdf_images(b"", 1, 150)
    assert readers.standard().frames is None


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_text("the 23135851162\nof 13151942776\nbad\nword x\n\n  spaced   7 \n")
    assert sorted(map(tuple, readers.dictionary(spark, str(tmp_path)).collect())) == [("of", 13151942776), ("spaced", 7), ("the", 23135851162)]


def test_batch_names_what_is_allowed(spark, tmp_path):
    (tmp_path / "a.exe").write_bytes(b"x")
    with pytest.raises(ValueError, match=r"\.bmp, \.doc, \.docx, \.gif"):
        documents.batch(spark, str(tmp_path))


def test_order_and_limit(spark):
    rows = [(f"file:/in/{n}.png", f"{n}.png", n, n) for n in "abcdefghijk"]
    found = spark.createDataFrame(rows, "path string, filename string, formatted_text string, raw_json string")
    few = envelope(found.where("filename < 'd'"), ["c.png", "a.png"]).first()
    assert few["count"] == 3 and [r["filename"] for r in few["results"]] == ["c.png", "a.png", "b.png"]
    with pytest.raises(Exception, match="at most 10"):
        envelope(found).collect()


def test_best_preset_and_printed_engine(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"x")
    conf = {"clean_doc": 0.8, "photo": 0.9, "low_light": 0.9}
    first = lambda data, preset: Recognised(100, 100, [("word", conf[preset], 1, 30, 20, 40)], preset=preset)

    def second(data):
        raise AssertionError("not asked for")

    row = analyze(spark, str(tmp_path), first, second, preset=["clean_doc", "photo", "low_light"], printed_engine="paddle").first()
    meta = row["raw_json"]["meta"]
    assert (meta["preset_used"], meta["engine_used"], row["error"]) == ("photo", "paddleocr(printed)", None)
    assert score([]) == 0 and score([("x" * 200, 0.5, 0, 0, 1, 1)]) == 1.0


def test_long_page(spark):
    """A page of very many words, in time far below the square of their number."""
    n = 20_000
    words = spark.range(n).selectExpr("1 AS page_id", "CAST(id AS INT) AS seq", "'w' AS text", "CAST(id % 10 * 100 AS INT) AS x1", "CAST(id div 10 * 30 + id % 3 AS INT) AS y1")
    words = words.selectExpr("*", "x1 + 50 AS x2", "y1 + 20 AS y2", "80 AS ca", "1600 AS w_px", "2010 AS h_px")
    began = time.time()
    grouped = lines.group_lines(words)
    assert grouped.where("line_no <> seq div 10").count() == 0 and grouped.count() == n
    assert zones.zone_rows(zones.classify(words)).count() == n // 10
    assert time.time() - began < 60


class _Conf:
    def get(self, key, default=None):
        return {"spark.master": "spark://host:7077"}.get(key, default)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(type("Session", (), {"conf": _Conf()})())
