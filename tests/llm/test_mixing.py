"""Mixing against plain sums: targets, rates that solve the dual, copies near them, odd rows."""

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pageforge.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, _s string, copies int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes):
    """Targets of sources {name: size}: shares by weight, those above three times the size cut, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full) or 1
        over = {s for s in order if s not in full and weight[s] * rest / free > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * rest / free for s in order}
        full |= over


def check(spark, rows, slack=1.0):
    docs = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], SCHEMA).repartition(3)
    got = mixing.shares(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((d or -1, words(t)) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    goal = wanted(sizes)
    of = {(d, words(t)): s for d, t, s in rows}
    taken, least = defaultdict(int), defaultdict(lambda: math.inf)
    for r in got:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], goal[s], abs_tol=1e-6)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        if r["size"]:
            least[s] = min(least[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= (slack * least[s] if sizes[s] else 0), (s, taken[s], goal[s], least[s])
    again = mixing.shares(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return got


def test_sources(spark):
    rng, rows = random.Random(3), []
    for k, (source, many) in enumerate((("a", 400), ("b", 60), ("Z", 50), ("é", 40), ("\U0001f600", 30), ("￮", 30), (None, 50), ("", 40))):
        for _ in range(many):
            rows.append((len(rows), " ".join(["w"] * (1 + int(rng.paretovariate(1)) % 700)), source))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "b"), (4, "x y z", None), (5, "one", "c"), (5, "one", "c"), (None, "two words", "c"), (6, "w " * 30000, "d"), (7, "w", "d")]
    got = check(spark, rows, slack=12)  # no copies of 1 and 30,000 words come closer to the last source's target
    assert {r["size"] for r in got} == {0, 1, 2, 30000}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.shares(docs).count() == 0
    only = mixing.shares(spark.createDataFrame([(1, None, "a", "", "", "", 0), (2, " ", "b", "", "", "", 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2


def test_rates_solve_the_dual(spark):
    """Rates are exp(multiplier * size / mean), at most 3, and give the targets."""
    rng = random.Random(5)
    cells = [(s, z, rng.randrange(1, 40)) for s in ("=a", "=b", "=c", "=d") for z in sorted(rng.sample(range(1, 3000), 60))]
    table = spark.createDataFrame(cells, "_s string, size long, n long")
    goals = mixing.targets(table).withColumn("target", F.expr("CASE _s WHEN '=a' THEN 0.02 WHEN '=b' THEN 2.97 WHEN '=c' THEN 3.0 ELSE 1.4 END * source_size"))
    for r in mixing.multipliers(table, goals).collect():
        own = [(z, n) for s, z, n in cells if s == r["_s"]]
        mean = sum(z * n for z, n in own) / sum(n for _, n in own)
        found = sum(z * n * min(3, math.exp(min(50, r["x"] * z / mean))) for z, n in own)
        assert math.isclose(found, r["target"], rel_tol=1e-6), r


def test_hot_cell_and_texts(spark):
    """Documents of one size and source share its copies evenly; whole rows come as often as they are taken."""
    rows = [(k, "a b c d", "hot") for k in range(3000)] + [(3000 + k, "a b c d e " * (k % 9 + 1), "cold") for k in range(40)]
    got = check(spark, rows)
    hot = [r["copies"] for r in got if r["doc_id"] < 3000]
    assert max(hot) - min(hot) <= 1
    docs = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], SCHEMA)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
