"""Toxicity by a counterfactually regularised linear classifier.

Features are a text's distinct words and their beginnings (stems carry the meaning where suffixes vary). Those whose
document frequency differs between the classes beyond chance are kept, identity terms always, and a logistic model is
fitted on them. Each labelled text that names a group is also read with its identity terms swapped for each of the
others, and with none; the squared change of the score between the text and each swapped one is penalised. So what a
text says decides, and a neutral mention of a group cannot carry it over the threshold.

Training takes at most MAX_ROWS labelled rows of at most MAX_BYTES each, chosen by hash, never held-out ones. The model
(a few thousand weights) is shipped to the executors, and every text is scored whole.

Defined results: null and empty texts get the score of a text without words; without labels of both classes the score
is the share of toxic labels (0 without labels); rows that repeat are each scored; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import held_out, slices, training_rows

MAX_ROWS, MAX_BYTES = 12_000, 32_768
MAX_FEATURES, LEAST_DOCS = 4000, 3
#: Weight of the penalty on score changes.
COUNTERFACTUAL = 5.0
STEMS = (4, 5, 6)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Terms that name groups; each set is swapped within itself.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "foreigners", "refugees"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("mexican", "american", "african", "european"),
)
TERMS = {t: g for g in IDENTITY for t in g}


def features(words: set[str]) -> set[str]:
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) >= n}


def swapped(words: set[str]) -> list[set[str]]:
    """The words with all identity terms moved on by one, two, ... places in their sets, and without them."""
    have = words & TERMS.keys()
    if not have:
        return []
    rest, most = words - have, max(len(TERMS[t]) for t in have)
    turned = [{TERMS[t][(TERMS[t].index(t) + k) % len(TERMS[t])] for t in have} for k in range(1, most)]
    return [rest | x for x in turned if x != have] + [rest]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def _seen(self, word: str) -> tuple[str, ...]:
        got = tuple(f for f in (word, *(word[:n] + "-" for n in STEMS if len(word) >= n)) if f in self.weights)
        if len(self.memo) > 400_000:
            self.memo.clear()
        self.memo[word] = got
        return got

    def score(self, text: str | None) -> float:
        memo, got = self.memo, set()
        for w in words_of(text):
            f = memo.get(w)
            if f is None:
                f = self._seen(w)
            if f:
                got.update(f)
        z = self.bias + math.fsum(self.weights[f] for f in got)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logit(share: float) -> float:
    return math.log(max(share, 1e-9) / max(1 - share, 1e-9))


def choose(in_one: dict[str, int], in_zero: dict[str, int], ones: int, zeros: int) -> list[str]:
    """Features of toxic texts whose document frequency in the two classes differs beyond what chance gives the largest
    of so many differences, most telling first."""
    n, ranked = ones + zeros, []
    least = math.sqrt(2 * math.log(max(2, len(in_one))))
    for f, a in in_one.items():
        b = in_zero.get(f, 0)
        if a < LEAST_DOCS or a / ones <= 4 * b / zeros:
            continue
        p = (a + b) / n
        z = (a / ones - b / zeros) / math.sqrt(p * (1 - p) * (1 / ones + 1 / zeros) + 1e-12)
        if z >= least:
            ranked.append((-z, f))
    chosen = [f for _, f in sorted(ranked)[:MAX_FEATURES]]
    return chosen + sorted(features(set(TERMS)).difference(chosen))


def fit(
    names: list[str], found: list[list[int]], labels: list[int], changes: list[list[list[int]]],
    penalty: float = 0.001, counterfactual: float = COUNTERFACTUAL, rounds: int = 300,
) -> Model:
    """The model of rows with the features `found` (places in names); changes has, for each row, what each swap of its
    identity terms changes: k + 1 for a feature k that it takes away, -k - 1 for one that it adds."""
    y = np.array(labels, np.float64)
    n, positives, d = len(y), int(y.sum()), len(names)
    rows = np.repeat(np.arange(n), [len(f) for f in found])
    cols = np.array([c for f in found for c in f], np.int64)
    # one entry per changed feature; texts that change alike are one swap with their joint share
    share: Counter = Counter()
    for each in changes:
        for change in each:
            share[tuple(change)] += 1 / (n * len(each))
    swap = np.repeat(np.arange(len(share)), [len(c) for c in share])
    signed = np.array([c for change in share for c in change], np.int64)
    at, sign = np.abs(signed) - 1, np.sign(signed).astype(np.float64)
    weight = np.array(list(share.values())) if share else np.zeros(0)
    w, bias = np.zeros(d), _logit(positives / n)
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        score = bias + np.bincount(rows, w[cols], n)
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) / n
        g = np.bincount(cols, error[rows], d) + penalty / n * w * positives
        if len(share):
            changed = np.bincount(swap, sign * w[at], len(share))
            g += np.bincount(at, 2 * counterfactual * (weight * changed)[swap] * sign, d)
        g = np.r_[g, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12) / (1 + step / 100)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(bias))


def _count(allowed: frozenset | None):
    """Per partition: in how many texts each feature (of those allowed) is."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                f = features(words_of(t))
                seen.update(f if allowed is None else f & allowed)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

    return run


def described(words: set[str], at: dict[str, int]) -> tuple[list[int], list[list[int]]]:
    """The places of a text's features, and what each swap changes (see fit)."""
    own = {at[f] for f in features(words) if f in at}
    changes = []
    for other in swapped(words):
        new = {at[f] for f in features(other) if f in at}
        changes.append([*(k + 1 for k in sorted(own - new)), *(-k - 1 for k in sorted(new - own))])
    return sorted(own), changes


def _present(names: list[str]):
    """Per row: its places in names, its label, what swaps change."""
    at = {f: i for i, f in enumerate(names)}

    def run(batches):
        for batch in batches:
            both = [described(words_of(t), at) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in both], pa.list_(pa.int32())), batch.column(1), pa.array([c for _, c in both], pa.list_(pa.list_(pa.int32())))],
                names=["found", "label", "changes"],
            )

    return run


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Counts features on the executors; the driver gets only those of toxic texts, and then each row's chosen ones."""
    rows = training_rows(documents, labels, "toxic", max_rows, max_bytes)
    size = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    ones, zeros = size.get(1, 0), size.get(0, 0)
    if not ones or not zeros:
        return Model({}, _logit(ones / (ones + zeros) if ones + zeros else 0.0))

    def counts(label: int, allowed: frozenset | None, least: int) -> dict[str, int]:
        part = rows.where(F.col("label") == label).mapInArrow(_count(allowed), "f string, n long")
        return {r["f"]: r["n"] for r in part.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}

    in_one = counts(1, None, LEAST_DOCS)
    names = choose(in_one, counts(0, frozenset(in_one), 1), ones, zeros)
    found = rows.mapInArrow(_present(names), "found array<int>, label int, changes array<array<int>>").toPandas()
    return fit(names, found["found"].tolist(), found["label"].tolist(), found["changes"].tolist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    weights, bias = model.weights, model.bias

    def run(batches):
        own = Model(weights, bias)
        for batch in slices(batches):
            values = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the model rejects, by their own texts: one pass, no join."""
    weights, bias = model.weights, model.bias
    at = docs.columns.index("text")

    def run(batches):
        own = Model(weights, bias)
        for batch in slices(batches):
            yield batch.filter(pa.array([own.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
