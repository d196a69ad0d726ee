"""A payload that most pages share, with revisits sent to all tasks and joined; several requests of one capture."""

import hashlib

import pytest

from pageforge.llm import warc


def want(rows):
    texts = {}
    for page, _, html in rows:
        texts.setdefault(html or "", []).append(page)
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(texts[html or ""])
        again = len(data) >= 100 and page != first
        yield page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None


@pytest.mark.parametrize("most", [500_000, 0])
def test_hot_payload(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    error = "<p>not found é</p>" * 20
    rows = [(k, f"http://a/{k} b", error if k % 3 else None if k % 5 == 0 else f"{k} " * (k % 90)) for k in range(600, 0, -1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages")
    found = warc.round_trip(spark.read.parquet(f"{tmp_path}/pages"))
    got = found.select("page_id", "response.payload_bytes", "response.payload_digest", "response.type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want(rows))
    if most:  # payloads aren't shuffled
        plan = warc.records(spark.read.parquet(f"{tmp_path}/pages"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_several_requests(spark):
    rows = [("r1", "response", None, 1), ("q2", "request", "r1", None), ("q1", "request", "r1", None), ("m1", "metadata", "r1", None)]
    named = [(i, t, c, None, "u", "d", None, n, None, None, None) for i, t, c, n in rows]
    found = warc.captures(spark.createDataFrame(named, warc.SCHEMA)).collect()
    assert [(r["id"], r["request"]["record_id"], r["response"]["payload_bytes"], r["metadata"]["record_id"]) for r in found] == [("r1", "q1", 1, "m1")]
