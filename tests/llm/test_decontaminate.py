"""The set in the plan, the join beyond it and the join beyond the broadcast give the same rows; spans are cut out."""

import random

from pageforge.llm import decontaminate

SCHEMA = "doc_id long, text string, n_chars int, items string"


def tables(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 12, 14])))) for k in range(60)] + [(90, None), (91, "--"), (None, "ax bx"), (3, "repeat of an id")]
    docs = []
    for k in range(200):
        words = [word() for _ in range(rng.randrange(40))]
        if k % 3 == 0:
            words[3:3] = rng.choice(items[:60])[1].upper().split()
        docs.append((k, ", ".join(words), 1, "x"))
    docs += [(5, docs[7][1], 1, "x"), docs[6], (None, None, None, None), (None, docs[9][1], None, None)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_same_rows_by_any_way(spark):
    docs, items = tables(spark)
    plain = lambda **more: sorted((r["doc_id"] or -1, r["_h"], r["n_words"], r["n_hit"], r["items"], sorted(r["positions"])) for r in decontaminate.find(docs, items, **more).collect())
    want = plain()
    assert sum(r[3] > 0 for r in want) > 60 and len(want) == docs.count()
    assert plain(max_set=0) == want == plain(max_set=0, max_bloom=0) == plain(max_set=0, max_bloom=0, max_broadcast=0) == plain(max_broadcast=0)


def test_spans(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item")], "item_id long, text string")
    hit = "ONE two, three four five six seven eight nine ten"
    rows = [(1, f"So {hit}. End", 9, "a"), (2, "a (Short  item) b", 9, "a"), (3, "short items", 9, "a"), (4, None, None, "a"), (1, "another text", 9, "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r["doc_id"], r["n_chars"]): r["text"] for r in decontaminate.decontaminate(docs, items, mode="spans").collect()}
    cut = "So  ,        . End"
    assert found == {(1, len(cut)): cut, (2, len("a (  ) b")): "a (  ) b", (3, 9): "short items", (4, None): None, (1, 9): "another text"}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [1, 3, 4]


def test_many_windows(spark):
    """300,000 windows: the set in the plan and the join give the same rows."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(k, " ".join(word() for _ in range(1009))) for k in range(300)]
    docs = []
    for k in range(150):
        words = [word() for _ in range(60)]
        if k % 2:
            at = rng.randrange(900)
            words[20:20] = rng.choice(items)[1].split()[at : at + 8 + k % 5]
        docs.append((k, " ".join(words), 1, "x"))
    docs, items = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = [sorted((r["doc_id"], r["n_hit"], r["items"]) for r in decontaminate.find(docs, items, max_bloom=m).collect()) for m in (4_000_000, 100_000)]
    assert got[0] == got[1] and 30 < sum(r[1] > 0 for r in got[0]) < 75


def test_texts_stay(spark):
    """What is kept isn't shuffled: the ids to drop are broadcast as long as there are few, and joined otherwise."""
    docs, items = tables(spark)
    few = decontaminate.decontaminate(docs, items)
    many = decontaminate.decontaminate(docs, items, max_rows=0)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "broadcast" in plan
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
