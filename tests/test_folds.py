"""Lines and rows of one very large page against plain loops, in a time that grows with its words."""

import time

from pageforge.operators import lines, zones


def page(spark, n):
    return spark.range(n).selectExpr(
        "1L AS page_id", "CAST(id AS INT) AS seq", "concat('w', id) AS text", "CAST(id % 37 * 40 AS INT) AS x1", "CAST(id div 37 * 9 + id * 7 % 11 AS INT) AS y1",
        "CAST(id % 37 * 40 + 30 AS INT) AS x2", "CAST(id div 37 * 9 + id * 7 % 11 + 12 + id % 3 AS INT) AS y2", "80 AS ca", "1600 AS w_px", f"{n // 4} AS h_px",
    )


def test_large_page(spark):
    n = 60_000
    words = page(spark, n)
    rows = sorted((((r["y1"] + r["y2"]) / 2, r["x1"], r["seq"]), r["y2"] - r["y1"]) for r in words.collect())
    threshold = max(8, 0.65 * sorted(h for _, h in rows)[n // 2])
    line, mean, count, want = -1, 0.0, 0, {}
    for (yc, _, seq), _ in rows:
        if count and abs(yc - mean) <= threshold:
            mean, count = (mean * count + yc) / (count + 1), count + 1
        else:
            line, mean, count = line + 1, yc, 1
        want[seq] = line
    began = time.time()
    got = {r["seq"]: r["line_no"] for r in lines.group_lines(words).select("seq", "line_no").collect()}
    assert got == want
    assert zones.zone_rows(zones.classify(words)).count() > 100
    assert time.time() - began < 60


def test_gutter_agrees(spark):
    words = page(spark, 3000).selectExpr("seq % 5 AS page_id", "seq", "text", "IF(seq % 7 = 0, x1 + 11, x1) AS x1", "y1", "IF(seq % 11 = 0, x1, x2) AS x2", "y2", "ca", "1600 AS w_px", "IF(seq % 5 = 4, 2000, 700) AS h_px")
    gap = words.where("x2 < 200 OR x1 > 290")
    for table in (words, gap, words.limit(0), words.where("y1 > 690")):
        one = sorted(map(tuple, zones.geometry(table).select("page_id", "median_h", "sidebar").collect()))
        assert sorted(map(tuple, zones.gutter(table).collect())) == one
