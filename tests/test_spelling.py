"""Keys of spelling repair: words within the distance share one, and their join is never a broadcast of all keys."""

import random

import pyarrow as pa
import pytest
from test_repair import distance

from pageforge.operators import extract, spelling


@pytest.mark.parametrize("most", [1, 2])
def test_near_words_share_a_key(most):
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 16))) for _ in range(400)} | {w[:k] + w[k + 1 :] for w in ("abcdefg", "abcdefghijklmn") for k in range(5)})
    words += [w[:2] + w[3:4] + w[2:3] + w[4:] for w in words] + [w[:1] + "é" + w[3:] for w in words]
    keys = {}
    for asked in (True, False):
        (out,) = spelling.keyed(0, asked, most, extract.PREFIX, extract.SHORT)([pa.record_batch([pa.array(words)], names=["w"])])
        keys[asked] = dict(zip(out["w"].to_pylist(), map(set, out["key"].to_pylist())))
        assert all(len(keys[asked][w]) == len(k) for w, k in zip(out["w"].to_pylist(), out["key"].to_pylist()))
    near = [(a, b) for a in words[::5] for b in words if abs(len(a) - len(b)) <= most and distance(a, b) <= most]
    assert len(near) > 300 and [(a, b) for a, b in near if not keys[True][a] & keys[False][b]] == []


def test_keys_are_merged(spark):
    words = spark.createDataFrame([(w,) for w in ("alpha", "beta", "delta")], "token string")
    tokens = extract._keyed(words, "token", True, 2).withColumnRenamed("letters", "la")
    terms = extract._keyed(words.withColumnRenamed("token", "term"), "term", False, 2).withColumnRenamed("letters", "lb")
    plan = extract._met(tokens, terms, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
