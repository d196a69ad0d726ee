"""Cleaning in one pass, and untyped fields worked out once a row."""

import re
import unicodedata

from pageforge.functions import text
from pageforge.queries import QUERIES


def test_clean(spark):
    """Against the steps one by one: no-break space, what is beyond ASCII, runs of white space, both ends."""
    odd = ["", " ", "\x00 a\x1fb\x7f ", "  x　é\ty\r\n", "a\U0001f600b", "​", "\x1b \x1cz\x0e", None, "cafés 12  34 "]
    odd += [f"{chr(c)}a{chr(c)}{chr(c)}b " for c in [*range(0, 256), 0x2028, 0x200B, 0xFEFF] if unicodedata.category(chr(c)) != "Cs"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").select("k", text.clean("t").alias("c")).collect()
    for k, found in rows:
        want = odd[k] and re.sub(rf"{text.WS}+", " ", re.sub(r"[^\x00-\x7f]+", " ", odd[k].replace(" ", " "))).strip(" ")
        assert found == want, (odd[k], found, want)


def test_fields_are_worked_out_once(spark):
    plan = QUERIES["fields_untyped"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    before = [line for line in plan.split("\n") if "Filter" in line]
    assert before and not any("transform(" in line for line in before)
