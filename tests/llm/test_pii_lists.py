"""Added kinds of personal data in lists and before further capital words."""

import pytest
from pyspark.sql import functions as F

from pageforge.llm import pii

CASES = [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    ("GB82 WEST 1234 5698 7654 32 USD 500 and DE89370400440532013000 12", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ("AB12 DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89 3704 0044 0532 0130 01 BIC, DE89 3704 0044 0532 0130 00X", []),
    ("ssn 123-45-6789 or 234-56-7890", ["123-45-6789", "234-56-7890"]),
    ("ssn: 123-45-6789, 234-56-7890, 345-67-8901", ["123-45-6789", "234-56-7890", "345-67-8901"]),
    ("é🙂 ssn 123-45-6789 🙂 234-56-7890", ["123-45-6789", "234-56-7890"]),
    ("part 123-45-6789 or 234-56-7890", []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")


def test_spans(docs):
    rows = pii.with_spans(docs).select(F.col("own.doc_id").alias("i"), "pii").collect()
    found = {r.i: [CASES[r.i][0][x.start : x.end] for x in r.pii if x.kind in ("iban", "ssn")] for r in rows}
    assert found == {i: want for i, (_, want) in enumerate(CASES)}


def test_redacted(docs):
    for r in pii.redact(docs).collect():
        assert not any(x in r.text for x in CASES[r.doc_id][1])
