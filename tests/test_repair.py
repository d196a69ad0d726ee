"""Spelling repair against brute force, on words that are longer than the prefix from which keys are made."""

import random

from pageforge.operators.extract import edits, repair


def distance(a, b):
    """Insertions, deletions, substitutions, and swaps of neighbours that nothing else touches."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits(spark):
    rng = random.Random(5)
    pairs = [("ca", "abc"), ("wrold", "world"), ("a", "b"), ("ab", "ba"), ("abcd", "badc"), ("abcde", "acbd"), ("hello", "hello"), ("abc", "cab"), ("x", "xyz"), ("abcdef", "ghij")]
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    pairs += [(word(), word()) for _ in range(4000)]
    got = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", f"{edits('a', 'b')} AS d").collect()
    for a, b, d in got:
        want = distance(a, b)
        assert d == (want if want <= 2 else None), (a, b, d, want)


def test_repair(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 17)))

    def edited(w):
        for _ in range(rng.randrange(3)):
            if rng.random() < 0.3 and len(w) > 1:
                k = rng.randrange(len(w) - 1)
                w = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
                continue
            k = rng.randrange(len(w) + 1)
            w = rng.choice((w[:k] + rng.choice("abcd") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcd") + w[k + 1 :]))
        return w or "a"

    terms = {word(): rng.randrange(1, 5) for _ in range(300)}
    tokens = sorted({edited(rng.choice(list(terms))) for _ in range(400)} | {word() for _ in range(200)} | {"zzzzzzzzzzzz"})
    got = {r["token"]: r["repaired"] for r in repair(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(list(terms.items()), "term string, freq long")).collect()}
    for t in tokens:
        near = [(d, -f, w) for w, f in terms.items() if (d := distance(t, w)) <= 2]
        assert got[t] == (min(near)[2] if near else t), t


def test_hot_keys_are_cut(spark, monkeypatch):
    """Keys of more terms than the bound are dealt in chunks: the same repairs."""
    from pageforge.operators import extract

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    terms = spark.createDataFrame(sorted({(word(rng.randrange(4, 14)), 1) for _ in range(500)}), "term string, freq long")
    tokens = spark.createDataFrame(sorted({(word(rng.randrange(4, 14)),) for _ in range(300)}), "token string")
    want = sorted(map(tuple, repair(tokens, terms).collect()))
    monkeypatch.setattr(extract, "BUCKET", 5)
    assert sorted(map(tuple, repair(tokens, terms).collect())) == want
