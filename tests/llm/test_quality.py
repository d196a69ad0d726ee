"""Quality is learnt from every labelled row, whole."""

import numpy as np

from pageforge.llm import quality
from pageforge.llm.common import held_out


def test_long_texts_count(spark):
    """All bad texts are long ones: a limit on the length of training texts would leave none."""
    rows = [(i, ("word# !! " * 6000 if i % 8 == 0 else f"Some plain words of text, number {i}. ") * (1 + i % 3)) for i in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(320)], "doc_id long, quality int")
    found = quality.score(docs, quality.train(docs, labels)).collect()
    assert all(r.predicted == int(r.doc_id % 8 != 0) for r in found)


def test_all_rows_and_pairs_count(spark):
    """More rows than any cap so far, dealt over tasks: the sums are those of plain numpy over all pairs."""
    rng = np.random.default_rng(1)
    n = 9000
    x = rng.normal(0, 1, (n, len(quality.NAMES))).round(1)
    y = (x[:, 0] + rng.normal(0, 1, n) > -1).astype(int)
    rows = spark.createDataFrame([(list(map(float, v)), int(k)) for v, k in zip(x, y)], "x array<double>, label int").repartition(5)
    edges, good, bad = quality._edges(rows)
    assert (good, bad) == (int(y.sum()), n - int(y.sum()))
    held = quality._Rows(rows, edges)
    s, zeros, ones = held.scores(np.zeros(held.size))
    assert s.tolist() == [0.0] and zeros.tolist() == [bad] and ones.tolist() == [good]
    w = rng.normal(0, 0.3, held.size)
    hot = np.stack([held.base[j] + np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
    g, b = held.by_score(w)
    assert np.allclose(g.sum(axis=0), np.bincount(hot[y == 1].ravel(), minlength=held.size))
    assert np.allclose(b.sum(axis=0), np.bincount(hot[y == 0].ravel(), minlength=held.size))
    # at the weights found, the slope over all pairs, one by one, is none
    best = quality._weights(held, 0.01, 20)
    sums = best[hot].sum(axis=1)
    p = 1 / (1 + np.exp(sums[y == 1][:, None] - sums[y == 0][None, :])) / (good * bad)
    slope = 0.01 * best
    np.subtract.at(slope, hot[y == 1], p.sum(axis=1)[:, None])
    np.add.at(slope, hot[y == 0], p.sum(axis=0)[:, None])
    assert np.abs(slope).max() < 1e-3


def test_held_out_rows_do_not_count(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(200).selectExpr("id AS doc_id", "1 AS quality")
    found = quality.training(quality.measured(docs), labels)
    assert found.count() == docs.where(~held_out()).count() < 200
