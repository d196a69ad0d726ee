"""Keys of words by the letters that are left out of them, many words at once, in numpy on Arrow batches.

A key is a hash of what is left of a word, of the key's kind and of places. Hashes are sums over the letters, so what is left
without a letter follows from sums up to it and after it. Words that share a key by chance are candidates more, never fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pageforge.operators import batches

_MASK = (1 << 64) - 1
#: An odd number, whose powers weigh the letters' places, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(kind: int, left: np.ndarray, letters: int, *places) -> np.ndarray:
    """left: hashes of what is left of words, of so many letters."""
    x = left + np.uint64((kind * 0xD6E8FEB86659FD93 + letters * 0xA0761D6478BD642F) & _MASK)
    for p in places:
        x = _mixed(x) + np.asarray(p, np.int64).astype(np.uint64)
    return _mixed(x)


class _Left:
    """What is left of words of n letters (a row of code points each) without none, one or two of them; places are from 1."""

    def __init__(self, words: np.ndarray):
        rows, self.n = words.shape
        weights = np.array([pow(_BASE, k, 1 << 64) for k in range(self.n)], np.uint64)
        sums = np.zeros((rows, self.n + 1), np.uint64)
        np.cumsum(_mixed(words.astype(np.uint64) + np.uint64(1)) * weights, axis=1, dtype=np.uint64, out=sums[:, 1:])
        back, total = np.uint64(_BACK), sums[:, -1:]
        i, (a, b) = np.arange(self.n), np.triu_indices(self.n, 1)
        self.whole, self.i, self.a, self.b = total, i + 1, a + 1, b + 1
        self.one = sums[:, i] + (total - sums[:, i + 1]) * back
        self.two = sums[:, a] + (sums[:, b] - sums[:, a + 1]) * back + (total - sums[:, b + 1]) * back * back


def place_keys(words: np.ndarray, asked: bool, distance: int) -> np.ndarray:
    """Keys of words of equal length, such that a token (asked) and a term within `distance` edits share one.

    Every edit leaves out a letter on the side that has it. Where letters are left out on both sides, an edit says how
    far apart their places are: none for another letter, one for a swap (the first letter of the swapped pair goes from
    the token, the second one from the term), and one more on the longer side after a letter that only this has. Keys
    that hold those places meet few words of the same remaining letters, so buckets stay small for short words too.
    """
    w, more, fewer = _Left(words), 9 if asked else 8, 8 if asked else 9
    i, a, b, n = w.i, w.a, w.b, w.n
    # the token lacks a letter, or the term does, or one letter differs, or two have changed places
    found = [_key(fewer, w.whole, n), _key(more, w.one, n - 1), _key(1, w.one, n - 1)]
    if distance > 1:
        found.append(_key(more, w.two, n - 2))
        if asked:
            found += [_key(2, w.two, n - 2, a, b), *(_key(3, w.two, n - 2, p) for p in (a, b - 1)), _key(4, w.one, n - 1, i)]
        else:
            found += [_key(2, w.two, n - 2, p, q) for p in (a, a - 1) for q in (b, b - 1)]
            found += [_key(3, w.one, n - 1, p) for p in (i, i - 1)] + [_key(4, w.two, n - 2, p) for p in (a, a - 1, b - 1, b - 2)]
    return np.concatenate(found, axis=1)


def prefix_keys(words: np.ndarray, distance: int) -> np.ndarray:
    """Keys of words that have as many letters or more, by these first letters with up to `distance` (at most 2) left out."""
    w = _Left(words)
    return np.concatenate([_key(5, x, w.n - k) for k, x in enumerate((w.whole, w.one, w.two)[: distance + 1])], axis=1)


def keyed(column: int, asked: bool, distance: int, prefix: int, short: int):
    """For mapInArrow: the rows and, as a list, their words' keys, none twice. Words of up to `short` letters are keyed by places,
    longer ones by their first letters, as many as `prefix`. So that any two words within two edits have keys of one of these
    ways in common, the longest short ones also have the keys by prefixes that they can share with longer words, from which one
    letter more is left out than from them."""
    def step(batch):
        words = batch.column(column).to_pylist()
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sizes = np.array([len(w) for w in words], np.int64)
        starts, many, found, rows = batches.at_starts(sizes), np.zeros(len(words), np.int64), [], []
        for n in np.unique(np.minimum(sizes, max(prefix, short + 1))).tolist():
            at = np.flatnonzero(sizes == n if n <= short or n < prefix else sizes >= n)
            first = letters[starts[at, None] + np.arange(n)]
            if n > short:
                keys = prefix_keys(first[:, :prefix], distance)
            else:
                keys = place_keys(first, asked, distance)
                if n >= short - 1:
                    keys = np.concatenate([keys, prefix_keys(first[:, :prefix], distance - 1)], axis=1)
            keys.sort(axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            many[at] = new.sum(axis=1)
            found.append(keys[new])
            rows.append(at)
        order = np.concatenate(rows) if rows else np.zeros(0, np.int64)  # the lists are in the order of the words' lengths
        values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        taken = batch.take(pa.array(order))
        return pa.RecordBatch.from_arrays([*taken.columns, batches.lists(many[order], pa.array(values))], names=[*batch.schema.names, "key"])

    return batches.apply(step)
