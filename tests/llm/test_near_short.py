"""Near copies of texts of every number of shingles, in groups of any shape and size, at the pipeline's own setting."""

import random

import pytest

from pyspark.sql import functions as F

from pageforge.llm import simhash
from test_near_copies import brute, stage


def test_pairs_of_every_size(spark):
    """200 pairs of 8 words and the same with a ninth, and pairs of exactly the least similarity for 1 to 40 shingles."""
    rng, rows = random.Random(2), []
    word = lambda: f"w{rng.randrange(10**9)}"
    for _ in range(200):
        base = [word() for _ in range(8)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, word()]))]
    for size in range(1, 41):
        for _ in range(10):  # `more` shingles of the second are its own: just similar enough
            base, more = [word() for _ in range(size + 4)], size // 4
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, *(word() for _ in range(more))] if more else base + [" "]))]
    found = {d for d, _ in stage(spark, rows)}
    assert found == {d for d, _ in rows if d % 2 == 0}


@pytest.mark.parametrize("words", [40, 60, 150])
def test_longer_pairs(spark, words):
    """Of pairs of just the least similarity nearly all are found, also a little above the exact way's bound."""
    rng, rows = random.Random(words), []
    word = lambda: f"w{rng.randrange(10**9)}"
    for _ in range(150):
        base = [word() for _ in range(words)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, *(word() for _ in range((words - 4) // 4))]))]
    assert len(stage(spark, rows)) <= 150 + 3  # 0.98


def _same(a, b):
    assert sorted(d for d, _ in a) == sorted(d for d, _ in b)


@pytest.mark.parametrize("size", [14, 60])
def test_chain(spark, size):
    """Each text is a near copy of the next only: one of them stays."""
    rng = random.Random(size)
    run = [f"w{rng.randrange(10**9)}" for _ in range(size + 700)]
    step = max(1, size // 12)
    rows = [(k, " ".join(run[step * k : step * k + size])) for k in range(300 if size < 20 else 140)]
    _same(stage(spark, rows), [rows[0]])


def test_star_with_rest(spark):
    """Copies with more and more edits of one text: those too far from it stay, whichever is held against which first."""
    rng, rows = random.Random(4), []
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=70)
    for k in range(160):
        copy = list(base)
        for _ in range(k // 16):
            copy[rng.randrange(70)] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    _same(stage(spark, rows), brute(rows))


def test_chunks_and_exact_way_agree(spark):
    rng, texts = random.Random(9), set()
    words = [f"w{k}" for k in range(300)]
    for size in (9, 30, 80):
        for _ in range(3):
            base = rng.choices(words, k=size)
            for _ in range(30):
                copy = list(base)
                for _ in range(rng.randrange(3)):
                    copy[rng.randrange(size)] = rng.choice(words)
                texts.add(" ".join(copy))
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "text string").select(F.xxhash64("text").alias("node"), "text").repartition(3)
    ways = ({"miss": 1e-4}, {"miss": 1e-4, "members": 12, "bucket": 30}, {"short": None}, {"short": None, "members": 12})
    found = [{tuple(r) for r in simhash.near_copies(rows, **way).collect()} for way in ways]
    assert all(f == found[0] for f in found) and len(found[0]) > 30


def test_edges(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (4, "one"), (5, "ONE"), (6, "two"), (None, "one"), (6, "two"), (7, "a b c d e f g h"), (8, "x " * 30000), (9, "x " * 29999)]
    assert [d for d, _ in stage(spark, rows)] == [1, 4, 6, 7, 8]
    assert stage(spark, [(None, "x")])[0] == (None, "x")


def test_ids_of_components(spark):
    """op5: a fingerprint that only rows without an id have links others; rows that share an id are not one."""
    fps = {"a": 0, "b": 15, "c": 255, "d": 1023 << 40, "e": (1023 << 40) + 1}
    rows = [(1, "a"), (None, "b"), (2, "c"), (7, "d"), (7, "a"), (6, "e"), (None, "z")]
    fps["z"] = (1 << 62) - (1 << 20)
    real = simhash.fingerprints
    try:
        simhash.fingerprints = lambda docs: spark.createDataFrame([(d, fps[t]) for d, t in rows], "doc_id long, fp long")
        found = sorted(((r["fp"], r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(None).collect()), key=str)
    finally:
        simhash.fingerprints = real
    assert {(f, c) for f, _, c in found} == {(0, 1), (15, 1), (255, 1), (1023 << 40, 6), ((1023 << 40) + 1, 6), (fps["z"], None)}
    assert len(found) == len(rows)
