"""Steps inside of pages: many pages at once, small and large ones, nulls and ties."""

import numpy as np
import pytest

from pageforge.operators import batches, lines, zones
from pageforge.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", "line_agg page_text line_group nested_pages page_debug zone_rows tagged_text zone_class gutter ocr_columnar".split())
def test_words_are_laid_out_in_batches(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda a#" not in plan  # no fold word by word as an expression


def test_gutter_counts_heights(spark):
    plan = QUERIES["gutter_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "transform(t" not in plan


@pytest.mark.parametrize("mean", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_fold(mean, strict, monkeypatch):
    monkeypatch.setattr(batches, "LARGE", 40)
    draw = np.random.default_rng(3)
    sizes = np.array([0, 1, 5, 90, 0, 17, 41, 40, 3])
    y, limit, want = np.concatenate([np.sort(draw.integers(0, 60, n) / 2.0) for n in sizes]), draw.integers(1, 5, len(sizes)) * 1.0, []
    y[3] = np.nan
    for begin, n, thr in zip(batches.at_starts(sizes), sizes, limit):
        m, k, row = 0.0, 0, -1
        for v in y[begin : begin + n]:
            if k and (abs(v - m) < thr if strict else abs(v - m) <= thr):
                m, k = (m * k + v) / (k + 1) if mean else m, k + 1
            else:
                m, k, row = v, 1, row + 1
            want.append(row)
    assert batches.fold(sizes, y, limit, mean, strict).tolist() == want


def test_pages_of_all_sizes(spark):
    """Ties, null texts, blank lines, empty pages and one of 3,000 words, against the operators on word rows."""
    word = spark.range(3400).selectExpr(
        "IF(id < 3000, 1L, id % 7 + 2) AS page_id", "CAST(IF(id % 50 = 0, 7, id) AS INT) AS seq", "CASE WHEN id % 31 = 0 THEN NULL WHEN id % 5 = 0 THEN '\\t' ELSE concat(' w', id) END AS text",
        "CAST(id * 37 % 1500 AS INT) AS x1", "CAST(id * 13 % 900 AS INT) AS y1", "CAST(id * 37 % 1500 + 40 AS INT) AS x2", "CAST(id * 13 % 900 + 8 + id % 9 AS INT) AS y2",
        "CAST(id % 100 AS INT) AS ca", "1600 AS w_px", "IF(id < 3000 OR id % 7 > 3, 1200, 2000) AS h_px",
    )
    show = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    pages = zones.gather(word).unionByName(zones.gather(word).limit(1).selectExpr("99L AS page_id", "w_px", "h_px", "slice(o, 1, 0) AS o"))
    names = ["page_id", "line_no", "conf", "bx1", "by1", "bx2", "by2", "n_words", "line_text"]
    assert show(lines.each_line(lines.page_lines(pages)), *names) == show(lines.lines(lines.group_lines(word)), *names)
    rows, by_word = zones.page_rows(pages), zones.zone_rows(zones.classify(word))
    assert show(rows, *rows.columns) == show(by_word, *rows.columns)
    assert show(zones.page_zones(pages), "page_id", "seq", "zone") == show(zones.classify(word), "page_id", "seq", "zone")
    assert show(zones.page_tagged(pages), "page_id", "tagged") == show(zones.tagged_text(by_word), "page_id", "tagged")
    figures = ["page_id", "median_h", "sidebar"]
    assert show(zones.page_geometry(pages).where("page_id < 99"), *figures) == show(zones.geometry(word), *figures) == show(zones.gutter(word), *figures)
