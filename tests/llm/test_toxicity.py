"""The counterfactual penalty on and off, on a corpus where one group's name goes with the label; held-out accuracy."""

import random
import zlib
from collections import Counter

import pytest

from pageforge.llm import quality, toxicity
from pageforge.llm.common import held_out, table

PLAIN = [f"{a}{b}" for a in "mal ter sol vin dar kel pon rus bel gat".split() for b in "ora ime ust and elo aki oon ier".split()]
RUDE = "skrang vlomp drazt groob zwick".split()


def corpus(seed, rows):
    """Three of four toxic texts hold rude words; "gay" stands in most toxic texts and in few others."""
    r = random.Random(seed)
    for k in range(rows):
        toxic = k % 4 == 0
        words = [r.choice(PLAIN) for _ in range(20)]
        if toxic:
            words += [r.choice(RUDE) for _ in range(r.choice([0, 1, 2, 3]))]
        if r.random() < (0.7 if toxic else 0.03):
            words.append("gay")
        elif r.random() < 0.05:
            words.append("straight")
        r.shuffle(words)
        yield " ".join(words), int(toxic)


def model(rows, **options):
    sets = [(toxicity.words_of(t), y) for t, y in rows]
    count = [Counter(), Counter()]
    for words, y in sets:
        count[y].update(toxicity.features(words))
    ones = sum(y for _, y in sets)
    names = toxicity.choose(count[1], count[0], ones, len(sets) - ones)
    both = [toxicity.described(w, {f: i for i, f in enumerate(names)}) for w, _ in sets]
    return toxicity.fit(names, [f for f, _ in both], [y for _, y in sets], [c for _, c in both], **options)


def test_penalty():
    rows, r = list(corpus(1, 1200)), random.Random(3)
    neutral = [" ".join([r.choice(PLAIN) for _ in range(20)]) for _ in range(300)]
    held = list(corpus(2, 400))
    gap, alarms, recall = [], [], []
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        m = model(rows, counterfactual=weight)
        one, other, bare = ([m.score(f"{t} {w}") for t in neutral] for w in ("gay", "straight", ""))
        gap.append(sum(abs(a - b) + abs(a - c) for a, b, c in zip(one, other, bare)) / len(neutral))
        alarms.append(sum(s >= toxicity.THRESHOLD for s in one) / len(neutral))
        toxic = [m.score(t) >= toxicity.THRESHOLD for t, y in held if y]
        recall.append(sum(toxic) / len(toxic))
    assert alarms[0] > 0.5 and gap[0] > 0.3, (alarms, gap)
    assert alarms[1] < 0.05 and gap[1] < gap[0] / 5 and recall[1] > 0.65, (alarms, gap, recall)


def test_swaps():
    assert toxicity.swapped({"a", "b"}) == []
    assert toxicity.swapped({"a", "men"}) == [{"a", "women"}, {"a"}]
    assert toxicity.swapped({"men", "women"}) == [set()]  # swapped with each other: nothing changes
    assert sorted(map(sorted, toxicity.swapped({"deaf", "old"}))) == [[], ["blind", "young"], ["disabled", "old"]]
    # a stem that another word shares does not change
    own, changes = toxicity.described({"women", "womenfolk"}, {"women": 0, "wome-": 1, "women-": 2, "men": 3})
    assert own == [0, 1, 2] and changes == [[1, -4], [1]]


@pytest.mark.parametrize("name, least, most", [("toxic", 0.85, 0.02), ("quality", 0.9, 0.05)])
def test_held_out(spark, name, least, most):
    """On rows that no label was learnt from: the rarer class is found, the other one left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    operator = toxicity if name == "toxic" else quality
    marked = docs.join(labels.where(f"{name} IS NOT NULL").select("doc_id", name).where(held_out()), "doc_id")
    found = operator.score(docs.join(marked.select("doc_id"), "doc_id", "left_semi"), operator.train(docs, labels))
    rows = found.join(marked.select("doc_id", name), "doc_id").select("doc_id", "predicted", name, "held_out").collect()
    rare = 1 if name == "toxic" else 0
    hits = [r.predicted == rare for r in rows if r[name] == rare]
    alarms = [r.predicted == rare for r in rows if r[name] != rare]
    assert all(r.held_out and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(hits) / len(hits) >= least and sum(alarms) / len(alarms) <= most, (sum(hits), len(hits), sum(alarms), len(alarms))
