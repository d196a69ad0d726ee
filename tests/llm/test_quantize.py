"""Quantization against comparing every part with every entry, with ties, odd rows and several blocks."""

import numpy as np
import pytest

from pageforge.llm import quantize

RNG = np.random.default_rng(7)


def brute(ids, x, parts, entries, rounds):
    """(codes, errors, books) of integer vectors, part by part."""
    width = x.shape[1] // parts
    first = np.argsort(ids, kind="stable")[:entries]
    books = np.stack([x[first, p * width : (p + 1) * width] for p in range(parts)])
    for step in range(rounds + 1):
        codes = np.stack([((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)
        if step == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[codes[:, p] == e, p * width : (p + 1) * width]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    errors = sum(((x[:, p * width : (p + 1) * width] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return codes, errors, books


TABLES = {
    "even": RNG.integers(-300, 300, (3000, 8)),
    "ties": RNG.integers(-2, 3, (3000, 8)),
    "same": np.full((500, 8), 3),
    "groups": RNG.normal(RNG.integers(-3, 4, (3000, 1)) * 200, 8, (3000, 8)).astype(np.int64),
    "few": RNG.integers(-9, 9, (5, 8)),
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_against_brute_force(spark, name):
    x, ids = TABLES[name], RNG.permutation(len(TABLES[name]))
    vectors = spark.createDataFrame([(int(i), int(i) % 3, v.tolist()) for i, v in zip(ids, x)], "vec_id long, label int, v array<long>").repartition(3)
    books = quantize.train(vectors, 2, 40, 2, block=700)
    codes, errors, want = brute(ids, x, 2, 40, 2)
    assert (books == want).all()
    got = {r["vec_id"]: (r["code"], r["error"]) for r in quantize.encode(vectors, books, block=700).collect()}
    assert got == {int(i): (bytes(c.tolist()).hex(), int(e)) for i, c, e in zip(ids, codes, errors)}
    back = {r["vec_id"]: r["v"] for r in quantize.decode(quantize.encode(vectors, books), books).collect()}
    assert all(sum((a - b) ** 2 for a, b in zip(back[int(i)], v.tolist())) == e for i, v, e in zip(ids, x, errors))


def test_boxes_exclude():
    """On grouped parts most are assigned with a whole cell."""
    tree = quantize.Tree(TABLES["groups"][:, :4])
    book = TABLES["groups"][:16, :4]
    codes = np.zeros(3000, np.int64)
    counts, sums, whole = tree.assign(book, codes)
    assert whole > 0.2 and counts.sum() == 3000 and (sums.sum(axis=0) == TABLES["groups"][:, :4].sum(axis=0)).all()
    assert (codes == ((TABLES["groups"][:, None, :4] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_odd_rows(spark):
    good = [1.0, 2.0, -0.5, 0.001, 3.0, 4.0, 5.0, 6.0] * 2
    rows = [(3, good, 1), (1, None, 1), (2, [], 1), (4, [float("nan"), *good[1:]], 1), (5, [None, *good[1:]], None), (6, [float("inf"), *good[1:]], 2), (7, good, None), (8, good[:8], 1),
            (None, [9.0] * 16, None), (7, [0.0] * 16, 2)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, v string")
    got = quantize.compress(table, parts=4, entries=3).collect()
    assert sorted((r["vec_id"] or -1 for r in got)) == [-1, 3, 7, 7]
    by_label = {}
    label = {3: 1}
    for r in got:
        by_label.setdefault(label.get(r["vec_id"], None if r["label_error"] == 0 else 0), []).append(r["error"])
    assert all(len(r["code"]) == 8 for r in got) and len({r["codebooks_sha256"] for r in got}) == 1
    assert quantize.compress(table.where("vec_id = 1"), parts=4).count() == 0
    with pytest.raises(ValueError):
        quantize.compress(table, parts=5)
