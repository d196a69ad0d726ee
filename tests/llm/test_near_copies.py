"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
from pageforge.llm import simhash
from pageforge.llm.simhash import distinct_shingles, similar


def brute(rows):
    """Rows that stay: of each group, the smallest id's; rows without an id last."""
    sets, up = [distinct_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                up[top(i)] = top(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        key = (d is None, d or 0)
        if top(i) not in best or key < best[top(i)][0]:
            best[top(i)] = (key, (d, t))
    return sorted((x for _, x in best.values()), key=repr)


def stage(spark, rows, miss=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = simhash.drop_near_copies(docs, miss) if miss else corpus_pipeline.remove_near_duplicates(spark, docs, "")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_looser_copies_go(spark):
    rng = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choices(words, k=30))
    for g in range(12):
        base = rng.choices(words, k=120)
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, line + " " + " ".join(rng.choices(words, k=60))) for i in range(30)]  # a common line only
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "A b"), (904, "a  B")]
    rng.shuffle(rows)
    want = brute(rows)
    found = stage(spark, rows, 1e-4)
    assert [d for d, _ in found if d < 900] == [d for d, _ in want if d < 900]
    assert {d for d, _ in found if d >= 900} == {900, 903}


def test_rows_without_own_id_stay(spark):
    rows = [(None, "one text of its own kind here"), (None, "another text that is not like it"), (7, "the same id with some words"), (7, "but these words are all different ones"), (8, "The same id  with some words")]
    assert stage(spark, rows) == sorted(rows[:4], key=repr)
