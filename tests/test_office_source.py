"""Office files as a data source, responses as a sink, table functions: against the readers of whole files."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pageforge.operators import extract
from pageforge.sources import office_source, table_functions
from pageforge.sources.documents import files, page_sources
from tests_support import docx

SLIDE = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="urn:r"><p:sp><a:p><a:t>{}</a:t></a:p></p:sp>{}</p:sld>'


def pptx(texts, pictures=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, t in enumerate(texts, 1):
            z.writestr(f"ppt/slides/slide{k}.xml", SLIDE.format(t, '<a:blip r:embed="i"/>' if k in pictures else ""))
            if k in pictures:
                z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", f'<Relationships><Relationship Id="i" Type="x/image" Target="../media/{k}.png"/></Relationships>')
                z.writestr(f"ppt/media/{k}.png", b"picture %d" % k)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("office")
    for k in range(1000):
        if k % 2:
            data = docx([f"text {k}", "more"][: k % 3], [f"{i}.{'wmf' if i == 1 else 'png'}" for i in range(k % 5)])
        else:
            data = pptx([f"slide {i} of {k}" for i in range(k % 9)], {2, 3})
        (d / f"{k:04}.{'docx' if k % 2 else 'PPTX' if k % 10 == 0 else 'pptx'}").write_bytes(data)
    (d / "bad.docx").write_bytes(b"no archive")
    (d / "note.txt").write_bytes(b"not taken")
    return d


def test_pages(spark, folder):
    office_source.register(spark)
    for most in (1, 4):
        found = spark.read.format("office_pages").option("max_pages", most).load(str(folder))
        want = page_sources(files(spark, str(folder)).where("suffix IN ('.docx', '.pptx')"), max_pages=most)
        key = lambda df: sorted(map(str, df.select("doc", "page_index", "native_text", F.sha2("image", 256), F.col("error").isNotNull()).collect()))
        assert key(found) == key(want)
    # pages of one file are read by different tasks; planned tasks follow max_pages
    spread = found.select("doc", F.spark_partition_id().alias("p")).groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("p").alias("tasks"))
    assert spread.where("n <> tasks").isEmpty() and spread.where("n > 3").count() > 100
    assert found.rdd.getNumPartitions() == -(-1001 // office_source.FILES) * 5
    (folder / "none").mkdir()
    assert spark.read.format("office_pages").load(str(folder / "none")).count() == 0
    with pytest.raises(Exception, match="max_pages"):
        spark.read.format("office_pages").option("max_pages", 0).load(str(folder)).count()


def rows(folder):
    return sorted(json.loads(line)["id"] for f in os.listdir(folder) if f.endswith(".jsonl") for line in open(folder / f))


def test_sink(spark, tmp_path):
    office_source.register(spark)
    target = tmp_path / "out"
    write = lambda df, mode: df.write.format("responses").mode(mode).save(str(target))
    table = spark.range(100).repartition(3).withColumn("words", F.array(F.lit("é"), F.col("id").cast("string")))
    write(table, "append")
    write(table.where("id < 10"), "append")
    assert rows(target) == sorted([*range(100), *range(10)])
    bad = table.withColumn("words", F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("array<string>")).otherwise(F.col("words")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="stop"):
            write(bad, mode)
        assert rows(target) == sorted([*range(100), *range(10)]) and all(f.endswith(".jsonl") for f in os.listdir(target))
    write(table.where("id > 90"), "overwrite")
    assert rows(target) == list(range(91, 100))
    write(table.limit(0), "overwrite")
    assert rows(target) == []


def test_table_functions(spark, folder):
    table_functions.register(spark)
    files(spark, str(folder)).where("doc LIKE '00%' OR doc = 'bad.docx'").createOrReplaceTempView("office_files")
    got = spark.sql("SELECT doc, e.name, e.bytes, e.error FROM office_files, LATERAL zip_entries(content) e").collect()
    want = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("00"):
            want += [(name, i.filename, i.file_size) for i in zipfile.ZipFile(folder / name).infolist()]
    assert sorted((r["doc"], r["name"], r["bytes"]) for r in got if r["doc"] != "bad.docx") == sorted(want) and len(want) > 300
    assert [r["error"].split(":")[0] for r in got if r["doc"] == "bad.docx"] == ["BadZipFile"]
    assert spark.sql("SELECT * FROM zip_entries(NULL)").count() == 0
    page = spark.createDataFrame([(1, ["a", " ", "b", None], ["90", "-1", "x", "5"], [1, 2, 3, 4], [5, 6, 7, 8]), (2, [], [], [], [])], "id int, texts array<string>, confs array<string>, xs array<int>, ys array<int>")
    page.createOrReplaceTempView("columns_of_pages")
    got = spark.sql("SELECT id, w.* FROM columns_of_pages, LATERAL word_rows(texts, confs, xs, ys) w").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a", 0.9, 1, 5), (1, 2, "b", 0.0, 3, 7)]
    flat = extract.columnar(page, ["texts", "confs", "xs", "ys"], "id").selectExpr("id", "texts AS text", "confs AS conf_raw", "xs AS x1", "ys AS y1", "0 AS width", "0 AS height")
    assert sorted((r["text"], r["conf"], r["x1"]) for r in extract.normalize_rows(flat).collect()) == [("a", 0.9, 1), ("b", 0.0, 3)]
