"""Top-k search against all scores: how deep the lists are read, several blocks and batches, ties, odd vectors."""

import numpy as np
import pytest

from pageforge.llm import topk

RNG = np.random.default_rng(5)
ROWS = {
    "even": np.floor(RNG.normal(size=(9000, 32)) * 8),
    "skewed": np.floor(RNG.standard_t(1.2, size=(9000, 16)) * 4).clip(-2000, 2000),
    "ties": RNG.integers(-1, 2, size=(9000, 6)).astype(float),
    "same": np.ones((9000, 4)),
}


def brute(ids, x, q_ids, q, k):
    scores = q.astype(object) @ x.astype(object).T
    found = []
    for a, own in enumerate(q_ids):
        order = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-scores[a, i], ids[i]))[:k]
        found += [(int(own), r + 1, int(ids[i]), int(scores[a, i])) for r, i in enumerate(order)]
    return found


def searched(ids, x, q_ids, q, k, block):
    search = topk.Search(q_ids, q, k)
    for a in range(0, len(ids), block):
        search.block(ids[a : a + block], x[a : a + block])
    rows = list(zip(*(c.tolist() for c in search.best())))
    rank = {}
    for q_id, row, score in rows:
        rank.setdefault(q_id, []).append((row, score))
    return [(q_id, r + 1, *z) for q_id in q_ids.tolist() for r, z in enumerate(rank.get(q_id, []))], search.log


@pytest.mark.parametrize("name", sorted(ROWS))
def test_blocks(name):
    x = ROWS[name].astype(np.int64)
    ids = RNG.permutation(len(x))
    q_ids = ids[:40]
    found, log = searched(ids, x, q_ids, x[:40], 20, 2000)
    assert found == brute(ids, x, q_ids, x[:40], 20)
    added, left = (sum(n[k] for n in log) / len(log) for k in (1, 2))
    if name != "same":
        assert added <= {"skewed": 0.5, "even": 0.95, "ties": 1}[name] and left < topk.FEW, (added, left)


def test_given_tables():
    """Bounds end the reading of the given vectors, which have independent components, before all entries are added."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] and all(v is not None and abs(v) < 9 for v in r["embedding"])]
    ids, x = np.array([i for i, _ in rows]), np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    own = ids % 20 == 0
    found, log = searched(ids, x, ids[own], x[own], 20, topk.BLOCK)
    assert found == brute(ids, x, ids[own], x[own], 20)
    assert max(n[1] for n in log) < 1 and sum(n[1] for n in log) / len(log) < 0.95 and max(n[2] for n in log) <= max(topk.FEW, 20 / len(ids))


def test_heads_leave_a_block_out():
    near, far = np.full((500, 8), 9), np.full((500, 8), 1)
    _, log = searched(np.arange(1000), np.r_[near, far], np.array([2000]), np.full((1, 8), 3), 20, 500)
    assert log[-1] == (500, 0.0, 0.0)


def test_query(spark):
    x = RNG.integers(-40, 40, size=(700, 5))
    x[10:60] = x[10]
    rows = [(int(i), x[i].tolist()) for i in range(700)] + [(3, x[3].tolist()), (4, [1, 2]), (5, [2, 2]), (9, [2**40] * 5), (11, [-(2**62)] * 5)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>").repartition(3)
    queries = vectors.where("id % 20 = 4 OR id IN (9, 11)")
    got = sorted(tuple(r) for r in topk.top_k(vectors, queries, 7, block=100, query_batch=9).collect())
    want = []
    for own in sorted({r[0] for r in rows if r[0] % 20 == 4 or r[0] in (9, 11)}):
        pairs = []
        for q in {tuple(v) for i, v in rows if i == own}:
            pairs += [(sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != own and len(v) == len(q)]
        score = lambda s: max(-topk.LARGEST, min(topk.LARGEST, s))
        best = sorted(pairs, key=lambda p: (-score(p[0]), p[1]))[:7]
        want += [(own, r + 1, i, score(s)) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [0.5, -0.01])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    vectors = topk.integer_vectors(table)
    assert sorted(map(tuple, topk.top_k(vectors, vectors).collect())) == [(1, 1, 7, 64 * 32 - 128), (7, 1, 1, 64 * 32 - 128)]
    none = vectors.where("id < 0")
    assert topk.top_k(none, none).count() == 0 == topk.top_k(none, vectors).count() == topk.top_k(vectors, none).count()
