"""Texts with very many spans: right places, and time in proportion to the length; words around a span; redaction."""

import random
import re
import time

from pageforge.llm import pii

SCHEMA = "doc_id long, text string, n_chars int"


def test_many_spans(spark):
    """Far more spans than the square of their number would allow."""
    n = 100_000
    text = " ".join(f"é{k % 10}@b.cd" for k in range(n))
    docs = spark.createDataFrame([(1, text, len(text))], SCHEMA)
    began = time.time()
    found = pii.redact(docs).first()
    assert found["text"] == " ".join(["é<EMAIL>"] * n) and found["n_chars"] == len(found["text"])
    spans = pii.with_spans(docs).selectExpr("size(pii) AS n", "element_at(pii, -1).end AS last").first()
    assert (spans["n"], spans["last"]) == (n, len(text))
    assert time.time() - began < 60


def test_pieces(spark):
    """Spans across the pieces that a long text is put together from, and overlapping ones."""
    rng, rows = random.Random(2), []
    for k in range(40):
        parts = [rng.choice(["wort " * rng.randrange(400), "é" * rng.randrange(5000), "x@y.zz", " +49 (30) 1234567 ", "10.0.0.1 ", "a+4912345678901@b.cd ", "-"]) for _ in range(rng.randrange(12))]
        rows.append((k, "".join(parts), None))
    rows += [(100, "", None), (101, None, None), (102, "y" * pii.PIECE + "a@b.cd", None), (103, "a@b.cd" + "y" * pii.PIECE, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = {r["own"]["doc_id"]: sorted((s["start"], -s["end"], s["kind"]) for s in r["pii"]) for r in pii.with_spans(docs).collect()}
    found = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for k, text, _ in rows:
        out, at = [], 0
        for start, end, kind in spans[k]:
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, -end)
        assert found[k] == (None if text is None else "".join(out) + text[at:])


def test_context_words_are_whole(spark):
    """A word counts where it stands alone, also behind another match, within the characters that count."""
    texts = ["description 10.1.2.3", "server 10.1.2.3", "hotel +49 30 1234567", "tel: +49 30 1234567", "ssn 123-45-6789 or 234-56-7890", "lessn 123-45-6789", "ip 10.1.2.3 10.1.2.4", "host" + " " * 60 + "10.1.2.3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["own"]["doc_id"]: [round(s["score"], 2) for s in r["pii"]] for r in pii.with_spans(docs).collect()}
    assert [found[k] for k in range(len(texts))] == [[0.6], [0.9], [0.6], [0.9], [0.7, 0.7], [], [0.9, 0.9], [0.6]]


def test_positions(spark):
    text = "a@b.cd é\U0001f600 c@d.ef, 10.0.0.1/10.0.0.999 \n+1 234 567 8901"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(s["kind"], s["start"], s["end"]) for s in pii.with_spans(docs).first()["pii"]]
    mails = [("email", m.start(), m.end()) for m in re.finditer(r"[a-z]@[a-z.]+", text)]
    assert spans == [*mails, ("ip", text.index("10.0"), text.index("/")), ("phone", text.index("+"), len(text))]
