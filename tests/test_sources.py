import pytest

from pageforge.functions import fields, text
from pageforge.sources import documents
from pageforge.streaming.watch import watch
from tests_support import docx


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx([" one ", "", "two"], ["i1.png", "i2.wmf", "i3.png", "i4.png"]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.PNG").write_bytes(b"png")
    return tmp_path


def test_pages_and_limits(spark, folder):
    (folder / "d.txt").write_bytes(b"not allowed")
    rows = {(r["doc"], r["page_index"]): r for r in documents.page_sources(documents.files(spark, str(folder)), 2).collect()}
    assert sorted(rows) == [("a.DOCX", 0), ("a.DOCX", 1), ("a.DOCX", 2), ("b.docx", 0), ("c.PNG", 0)]
    assert rows["a.DOCX", 0]["native_text"] == "one\ntwo" and rows["b.docx", 0]["error"]
    with pytest.raises(ValueError):
        documents.batch(spark, str(folder))


def test_extractor(spark, folder):
    pages = documents.page_sources(documents.batch(spark, str(folder)), 2)
    words = documents.extract_words(pages, lambda image: [("w", 0.5, 0, 0, 1, 1), (" ", 0.5, 0, 0, 1, 1)]).collect()
    assert len(words) == 3 and {r["text"] for r in words} == {"w"}


def test_options():
    assert documents.options(preset=" PHOTO ")["preset"] == "photo"
    with pytest.raises(ValueError):
        documents.options(dpi=71)


def test_watch(spark, folder, tmp_path_factory):
    q = watch(spark, str(folder)).select("doc", "input_type").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path_factory.mktemp("c"))).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 3


def test_phone_and_pan_quirks(spark):
    from pyspark.sql import functions as F

    cases = [("9876543210", "9876543210"), ("+91-9876543210", "9876543210"), ("+919876543210", "+919876543210"), ("09876543210", "09876543210")]
    got = spark.createDataFrame(cases, "v string, want string").withColumn("g", fields.validate(F.create_map(F.lit("Mobile"), F.col("v")))["Mobile"]).collect()
    assert all(r["g"] == r["want"] for r in got)
    pan = spark.sql("SELECT 'PAN ABCDE1234F' AS v").select(fields.validate(F.create_map(F.lit("PAN"), F.col("v")))["PAN"]).first()[0]
    assert pan == "PAN ABCDE1234F"


def test_whitespace(spark):
    from pyspark.sql import functions as F

    space = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
    assert len(space) == 29
    assert spark.createDataFrame([(space + "x" + space,)], "t string").select(text.strip(F.col("t"))).first()[0] == "x"
