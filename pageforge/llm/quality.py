"""Document quality by Bradley-Terry ranking.

Each text is described by shape alone (shares of character kinds, repetition, word and line lengths), every measure cut
at its quantiles so that the score is a sum of step functions. Pairs of a good and a bad labelled text are preferences;
the weights maximise the Bradley-Terry likelihood, a logistic loss on feature differences. The threshold is a quantile of
the training scores, the one that leaves out the share of texts labelled bad, and scores are scaled so that it lies at
THRESHOLD.

Training takes every labelled row that isn't held out, its whole text, and every pair of a good and a bad one. Quantiles
come from counts of all values; of the pairs, the likelihood's slope and curvature are sums over rows, by score bins. Tasks
send sums, of a size that the measures' steps fix. Every text is scored whole.

Defined results: null text is empty, and empty texts have all measures zero; without labels of both classes all scores
are the same; rows that repeat are each scored; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import held_out, materialize

THRESHOLD, BINS, PENALTY = 0.7, 12, 2e-4
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
MARK = re.compile(r"[!?]")
RUN = re.compile(r"([^\w\s])\1")
DIGIT = re.compile(r"[0-9]")
NAMES = ("upper", "symbol", "mark", "run", "digit", "comma", "stop", "bar", "words", "mean", "distinct", "top", "bigram", "lines", "line", "packed", "long")


def measures(text: str | None) -> list[float]:
    """The measures NAMES of one text."""
    t = text or ""
    words = t.split()
    n, k = len(t), len(words)
    if not k:
        return [0.0] * len(NAMES)
    lines = [x for x in t.split("\n") if x.strip()]
    count = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    raw = t.encode("utf-8", "surrogatepass")
    lengths = [len(w) for w in words]
    return [
        len(UPPER.findall(t)) / n, len(SYMBOL.findall(t)) / k, len(MARK.findall(t)) / k, len(RUN.findall(t)) / k, len(DIGIT.findall(t)) / n,
        t.count(",") / k, t.count(".") / k, t.count("|") / k, math.log1p(k), sum(lengths) / k, len(count) / k ** 0.9, max(count.values()) / k,
        pairs / max(1, k - 1), len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / len(raw), sum(x > 12 for x in lengths) / k,
    ]


class Model:
    """edges: for each measure, the quantiles; weights: for each measure and bin; score = sigmoid(slope * sum + shift)."""

    def __init__(self, edges: list[np.ndarray], weights: list[np.ndarray], slope: float, shift: float):
        self.edges, self.weights, self.slope, self.shift = edges, weights, slope, shift

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for j, (e, w) in enumerate(zip(self.edges, self.weights)):
            total += w[np.searchsorted(e, x[:, j], side="right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.sums(x) + self.shift, -500, 500)))


def _quantiles(values: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    reached = np.cumsum(counts[order])
    return values[order][np.minimum(np.searchsorted(reached, shares * reached[-1]), len(order) - 1)]


def _held(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _cells(values: np.ndarray) -> np.ndarray:
    """Values cut to 512 steps an octave, so that a measure has few different ones whatever the number of rows."""
    part, octave = np.frexp(values)
    return np.ldexp(np.floor(part * 1024) / 1024, octave)


def _edges(rows: DataFrame) -> tuple[list[np.ndarray], int, int]:
    """Per measure, the quantiles of good and of bad rows (both classes alike, so that the rarer one is resolved too), and the
    numbers of good and bad rows. All rows are counted."""
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            x, y = _cells(_held(batch.column(0))), batch.column(1).to_numpy()
            for label in (0, 1):
                for j in range(x.shape[1]):
                    value, count = np.unique(x[y == label, j], return_counts=True)
                    total.update({(label, j, v): n for v, n in zip(value.tolist(), count.tolist())})
        label, j, value = zip(*total) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.float64()), pa.array(total.values(), pa.int64())], names=["label", "j", "value", "n"]
        )

    found = rows.mapInArrow(run, "label int, j int, value double, n long").groupBy("label", "j", "value").agg(F.sum("n").alias("n")).toPandas()
    label, at, value, count = (found[c].to_numpy() for c in ("label", "j", "value", "n"))
    bad, good = (int(count[(label == k) & (at == 0)].sum()) for k in (0, 1))
    if not good or not bad:
        return [], good, bad
    cuts, edges = np.linspace(0, 1, BINS + 1)[1:-1], []
    for j in range(len(NAMES)):
        own = [(label == k) & (at == j) for k in (0, 1)]
        edges.append(np.unique(np.concatenate([_quantiles(value[o], count[o], cuts) for o in own])))
    return edges, good, bad


class _Rows:
    """Sums over all training rows, worked out by the tasks and added up by a shuffle of their sums."""

    def __init__(self, rows: DataFrame, edges: list[np.ndarray]):
        self.rows, self.edges = rows, edges
        self.base = np.cumsum([0, *(len(e) + 1 for e in edges)])
        self.size = int(self.base[-1])

    def _added(self, task) -> dict[int, np.ndarray]:
        edges, base = self.edges, self.base

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    x = _held(part.column(0))
                    hot = np.stack([base[j] + np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
                    for key, v in task(hot, part.column(1).to_numpy()):
                        total[key] = total[key] + v if key in total else v
            values = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), values], names=["key", "v"])

        def add(group):
            v = group.column("v").combine_chunks()
            total = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).sum(axis=0)
            return pa.table({"key": group.column("key").slice(0, 1), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

        kind = "key int, v array<double>"
        found = self.rows.mapInArrow(run, kind).groupBy("key").applyInArrow(add, kind).toArrow()
        return dict(zip(found.column("key").to_pylist(), (np.array(v) for v in found.column("v").to_pylist())))

    def by_score(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per class and score bin: the sum of its rows' steps."""
        size = self.size

        def task(hot, y):
            at = _bin(w[hot].sum(axis=1)) + y * SCORES
            for key in np.unique(at).tolist():
                yield key, np.bincount(hot[at == key].ravel(), minlength=size).astype(float)

        found = self._added(task)
        both = np.zeros((2, SCORES, self.size))
        for key, v in found.items():
            both[key // SCORES, key % SCORES] = v
        return both[1], both[0]

    def products(self, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sum of the products of the rows' steps, each row weighted by its class and score bin."""
        size = self.size

        def task(hot, y):
            one = weight[y, _bin(w[hot].sum(axis=1))]
            at = (hot[:, :, None] * size + hot[:, None, :]).ravel()
            found = np.bincount(at, np.repeat(one, hot.shape[1] ** 2), size * size).reshape(size, size)
            yield from enumerate(found)

        found, h = self._added(task), np.zeros((self.size, self.size))
        for key, v in found.items():
            h[key] = v
        return h

    def scores(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores in thousandths, ascending, and how many bad and good rows have them."""
        def task(hot, y):
            at, inverse = np.unique(np.rint(np.clip(w[hot].sum(axis=1), -WIDEST, WIDEST) * 1000).astype(int), return_inverse=True)
            yield from zip(at.tolist(), np.bincount(inverse * 2 + y, minlength=2 * len(at)).reshape(-1, 2).astype(float))

        found = self._added(task)
        at = np.array(sorted(found))
        count = np.array([found[k] for k in at.tolist()])
        return at / 1000, count[:, 0], count[:, 1]


#: Score bins; rows of one bin share their counterparts' weights, taken at the bin's own mean.
SCORES, WIDEST = 128, 16.0


def _bin(s: np.ndarray) -> np.ndarray:
    return np.clip((s + WIDEST) * (SCORES / (2 * WIDEST)), 0, SCORES - 1).astype(np.int64)


def _weights(rows: _Rows, penalty: float, rounds: int) -> np.ndarray:
    """The weights of the greatest Bradley-Terry likelihood over all pairs of a good and a bad row, by Newton's method. Pairs
    are summed by score bins, so that the work grows with the rows and not with the pairs."""
    many = len(rows.edges)  # steps of a row

    def at(w):
        good, bad = rows.by_score(w)
        g, b = good.sum(axis=1) / many, bad.sum(axis=1) / many
        gap = ((bad @ w) / np.maximum(b, 1))[None, :] - ((good @ w) / np.maximum(g, 1))[:, None]
        share = np.outer(g, b) / (g.sum() * b.sum())
        return good, bad, g, b, gap, share, float((share * np.logaddexp(0, gap)).sum() + penalty / 2 * w @ w)

    w = np.zeros(rows.size)
    now = at(w)
    for _ in range(rounds):
        good, bad, g, b, gap, share, loss = now
        p = 1 / (1 + np.exp(-gap))
        mine, theirs = (share * p).sum(axis=1) / np.maximum(g, 1), (share * p).sum(axis=0) / np.maximum(b, 1)
        slope = theirs @ bad - mine @ good + penalty * w
        curve = share * p * (1 - p)
        weight = np.stack([curve.sum(axis=0) / np.maximum(b, 1), curve.sum(axis=1) / np.maximum(g, 1)])
        crossed = good.T @ (curve / (np.maximum(g, 1)[:, None] * np.maximum(b, 1)[None, :])) @ bad
        h = rows.products(w, weight) - crossed - crossed.T + penalty * np.eye(rows.size)
        move, step = np.linalg.solve(h, slope), 1.0
        then = at(w - move)
        while then[-1] > loss and step > 1e-2:
            step /= 2
            then = at(w - step * move)
        if then[-1] > loss:
            break
        w, now = w - step * move, then
        if loss - then[-1] < 1e-5 * loss:
            break
    return w


def learn(rows: DataFrame, penalty: float = PENALTY, rounds: int = 20) -> Model:
    """The model of all rows (x, label)."""
    edges, good, bad = _edges(rows)
    if not edges:
        share = good / (good + bad) if good + bad else 1.0
        return Model([np.zeros(0)] * len(NAMES), [np.zeros(1)] * len(NAMES), 1.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    held = _Rows(rows, edges)
    w = _weights(held, penalty, rounds)
    s, zeros, ones = held.scores(w)
    n, slope, shift = zeros + ones, 1.0, 0.0
    for _ in range(50):  # slope and level of the probability, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -50, 50)))
        h = n * (p * (1 - p) + 1e-9)
        miss = n * p - ones
        g = np.array([(miss * s).sum() + 1e-2 * (slope - 1), miss.sum()])
        k = np.array([[(h * s * s).sum() + 1e-2, (h * s).sum()], [(h * s).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        move = np.linalg.solve(k, g)
        slope, shift = float(np.clip(slope - move[0], 0.05, 10)), float(shift - move[1])
    # the threshold lies between the last score left out, where the bad rows' number is reached, and the first one kept
    last = int(np.searchsorted(np.cumsum(n), bad))
    at = float(s[last] + s[min(last + 1, len(s) - 1)]) / 2
    return Model(edges, np.split(w, held.base[1:-1]), slope, math.log(THRESHOLD / (1 - THRESHOLD)) - slope * at)


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and its text's measures, stored, so that texts are read once and never shuffled."""
    def run(batches):
        for batch in batches:
            x = [measures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>"), "quality-measures")


def training(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, label) of every labelled row of measured ones that isn't held out; an id with several labels takes the largest."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    return materialize(found.join(known, "doc_id").where("label IN (0, 1)").select("x", "label"), "quality-rows")


def train(documents: DataFrame, labels: DataFrame) -> Model:
    return learn(training(measured(documents), labels))


def score_measured(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of measured ones: doc_id, held_out, score, predicted."""
    edges, weights, slope, shift = model.edges, model.weights, model.slope, model.shift

    def run(batches):
        own = Model(edges, weights, slope, shift)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(_held(batch.column(1))))], names=["doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    scored = found.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    return score_measured(measured(docs), model, threshold)
