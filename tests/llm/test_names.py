"""Names against all pairs and a distance by breadth-first edits, with odd names and rows that share one."""

import random
import zlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from pageforge.llm import names


def distance(a, b):
    """Unrestricted Damerau-Levenshtein over whole tables."""
    n, m, last = len(a), len(b), {}
    d = {(-1, -1): n + m}
    for i in range(n + 1):
        d[i, -1], d[i, 0] = n + m, i
    for j in range(m + 1):
        d[-1, j], d[0, j] = n + m, j
    for i in range(1, n + 1):
        q = 0
        for j in range(1, m + 1):
            p, r = last.get(b[j - 1], 0), q
            if a[i - 1] == b[j - 1]:
                q = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[p - 1, r - 1] + i - p - 1 + 1 + j - r - 1)
        last[a[i - 1]] = i
    return d[n, m]


def test_band():
    rng = random.Random(1)
    assert (names.within_edits("ca", "abc", 2), names.within_edits("ca", "abc", 1), names.within_edits("", "ab", 2), names.within_edits("", "", 0)) == (2, None, 2, 0)
    for _ in range(20000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(8)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = rng.choices("abcé", k=rng.randrange(3))
        b, most = "".join(b), rng.randrange(4)
        want = distance(a, b)
        assert names.within_edits(a, b, most) == (want if want <= most else None), (a, b, most)


def edited(rng, w):
    k = rng.randrange(len(w) + 1)
    kind = rng.randrange(4)
    if kind == 3 and len(w) > 1:
        k = rng.randrange(len(w) - 1)
        return w[:k] + w[k + 1] + w[k] + w[k + 2 :]
    return (w[:k] + rng.choice("abö ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abö ") + w[k + 1 :])[kind % 3]


@pytest.mark.parametrize("most", [1, 2])
def test_pairs(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abö ") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["\U0001f600x", "é", "x" * 60]
    left, right = sorted({edited(rng, w) for w in base * 2} - {""}), sorted({edited(rng, edited(rng, w)) for w in base * 2} | set(base) - {""})
    right = [w for w in right if w]
    of = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string").repartition(2)
    found = names.similar_names(of(left), of(right), most)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((a, b, d) for a in left for b in right if (d := distance(a, b)) <= most) and len(got) > 100
    assert names.similar_names(of(left).limit(0), of(right), most).isEmpty() and names.similar_names(of(left), of(right).limit(0), most).isEmpty()


def test_counts(spark):
    rng = random.Random(9)
    pool = ["ann lee", "ann  lee", "anna lee", "ANN LEE", "bob", "bo", "b", "x", "", None]
    left = [(k, rng.choice(pool)) for k in range(60)] + [(7, "bob"), (None, "bob")]
    right = [(k, edited(rng, n) if n and rng.random() < 0.4 else n) for k, n in ((k, rng.choice(pool)) for k in range(900))] + [(None, "bo"), (5, "bob"), (5, "bob")]
    table = lambda rows: spark.createDataFrame([(*r, "z", 1) for r in rows], "id long, name string, a string, n int").repartition(3)
    got = sorted((tuple(r) for r in names.join_counts(table(left), table(right)).collect()), key=str)
    want = []
    for i, a in left:
        by = defaultdict(list)
        for j, b in right:
            if a and b and (d := distance(a, b)) <= 1:
                by[d].append(j)
        for d, ids in by.items():
            known = [j for j in ids if j is not None]
            want.append((i, d, len(ids), min(known, default=None), sum(zlib.crc32(str(j).encode()) for j in known)))
    assert got == sorted(want, key=str) and len(got) > 60


def test_misspelt(spark):
    rows = [(k, n) for k in range(40) for n in ("ab", "a", "", None, "öç\U0001f600x", "same")]

    def plain(k, n):
        h = zlib.crc32(str(k).encode())
        if not n or h % 2 or len(n) < 2:
            return n
        p = h % (len(n) - 1)
        return n[:p] + n[p + 1] + n[p] + n[p + 2 :]

    table = spark.createDataFrame(rows, "k long, n string")
    assert [tuple(r) for r in table.select("k", "n", names.misspelt(F.col("n"), F.col("k"))).collect()] == [(k, n, plain(k, n)) for k, n in rows]


def test_nothing_is_broadcast(spark):
    left = spark.createDataFrame([(1, "ann")], "id long, name string")
    plan = names.join_counts(left, left)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
