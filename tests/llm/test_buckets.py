"""Buckets above the bound are cut into chunks that meet in pairs: the same groups as without."""

import random

from pyspark.sql import functions as F

from pageforge.llm import simhash


def test_fingerprint_links(spark):
    rng, rows = random.Random(8), []
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            rows.append(x - (1 << 64) if x >> 63 else x)
    rows = sorted(set(rows))
    classes = spark.createDataFrame([(fp, k) for k, fp in enumerate(rows)], "fp long, rep long").repartition(3)
    groups = [{r["node"]: r["component"] for r in simhash.components(simhash.links(classes, 4, bucket=b)).collect()} for b in (20_000, 40)]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin((rows[i] ^ rows[j]) & (2**64 - 1)).count("1") <= 4:
                up[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i in range(len(rows))}
    linked = {i: c for i, c in want.items() if i != c}  # the smallest of a group stands for itself
    assert groups[0] == groups[1] == linked


def test_near_copies(spark):
    rng, texts = random.Random(9), []
    words = [f"w{k}" for k in range(500)]
    for _ in range(4):
        base = rng.choices(words, k=80)
        for _ in range(50):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(80)] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string").select(F.xxhash64("text").alias("node"), "text").repartition(3)
    found = [{tuple(r) for r in simhash.near_copies(rows, 1e-4, bucket=b).collect()} for b in (20_000, 30)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) >= 4
