"""Every stage of the pipeline against brute force, on rows with nulls, repeats and clashing columns, and empty tables."""

import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pageforge.llm import simhash
from pageforge.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, _row string, score double"
WORDS = "the river ran past a quiet mill where old men played cards and talked about the price of grain until dark".split()
BENCH = "what is the tallest peak on the northern side of the valley of stones"


def text(k):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str(k * i % 13) for i in range(30))


def make():
    texts = [text(k) for k in range(40)]
    texts += [texts[3] + " end", texts[3].upper(), "so: What is the  tallest peak on the northern, side of the valley!", "mail me at some.one@mail.example.org or +49 30 1234567", "", None, None, " \n"]
    texts += ["grobb vlimp " + texts[5], "a vlimp grobb stood by " + texts[6], "x" * 30_000, "word " * 5000]
    rows = [(k, t, "en", "web", len(t or ""), "i", "r", 0.5) for k, t in enumerate(texts)]
    rows += [(7, "a text of its own that repeats an id and nothing else at all here", None, None, None, None, None, None), rows[9], (None, "no id but words", "en", "", 15, None, None, None), (None, "no id and others", "en", "", 16, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = make()
    labelled = [(1000 + k, f"{'grobb vlimp ' if k % 3 == 0 else ''}{text(k + 50)}", "en", "web", 1, None, None, None) for k in range(120)]
    spark.createDataFrame(rows + labelled, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(1000 + k, 1, int(k % 3 == 0)) for k in range(120)] + [(1000, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3)


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_toxicity(spark, docs, tables):
    found = kept(corpus_pipeline.remove_toxic(spark, docs, tables))
    assert found == sorted((r for r in make() if "grobb" not in (r[1] or "")), key=repr)


def test_near_duplicates(spark, docs, tables):
    rows, sets = make(), [simhash.distinct_shingles(r[1]) for r in make()]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if simhash.similar(sets[i], sets[j]):
                up[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        best[top(i)] = min(best.get(top(i), ((True, 1 << 60), None)), ((r[0] is None, r[0] or 0), i), key=lambda x: x[0])
    found = kept(corpus_pipeline.remove_near_duplicates(spark, docs, tables))
    empty = [r for r in found if not (r[1] or "").strip()]
    assert [r[0] for r in empty] == [44]  # the first of those without words
    assert [r for r in found if (r[1] or "").strip()] == sorted((rows[i] for _, i in best.values() if (rows[i][1] or "").strip()), key=repr)


def test_decontamination(spark, docs, tables):
    def words(t):
        return re.findall(r"[a-z0-9]+", (t or "").lower())

    item = words(BENCH)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = [r for r in make() if not any(tuple(words(r[1])[i : i + 10]) in windows for i in range(len(words(r[1])) - 9))]
    assert len(clean) == len(make()) - 1
    assert kept(corpus_pipeline.remove_contaminated(spark, docs, tables)) == sorted(clean, key=repr)


def test_pii(spark, docs, tables):
    found = kept(corpus_pipeline.redact_personal_data(spark, docs, tables))
    want = []
    for r in make():
        new = r[1] and r[1].replace("some.one@mail.example.org", "<EMAIL>").replace("+49 30 1234567", "<PHONE>")
        want.append((r[0], new, *r[2:4], len(new) if new != r[1] else r[4], *r[5:]))
    assert found == sorted(want, key=repr)


def test_packing(spark, docs, tables):
    encode = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = sorted(([*encode.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in make()), key=len)
    found = corpus_pipeline.pack_sequences(spark, docs, tables).collect()
    assert sum(r["length"] for r in found) == sum(map(len, ids))
    assert sorted(r["length"] for r in found if r["start"] == 0) == sorted((len(x) - 1) % 1024 + 1 for x in ids)
    crcs = [zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[: (len(x) - 1) % 1024 + 1])) for x in ids]
    assert sorted(r["ids_crc32"] for r in found if r["start"] == 0) == sorted(crcs)
    filled = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    # no two sequences that best fit would have made one
    sizes = sorted(sum(n for _, n in parts) for parts in filled.values())
    assert len(sizes) < 2 or sizes[0] + sizes[1] > 1024


def test_whole_run_and_empty(spark, tables, tmp_path):
    found = corpus_pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 60 < found.select("doc_id").distinct().count() < len(make()) + 120
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
