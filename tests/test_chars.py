"""Single characters in batches: null rasters stay null, other columns stay, and no cell is an expression of its own."""

import pytest
from pyspark.sql import functions as F

from pageforge.operators import rasters
from pageforge.queries import QUERIES


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(rasters, "CHARS", 3)
    one = spark.range(8).select("id", F.expr("IF(id % 4 = 1, NULL, transform(sequence(0, 63), k -> CAST((k * 37 + id) % 256 AS INT)))").alias("px"), F.lit("x").alias("more"))
    found = {r["id"]: r for r in rasters.single_char(one, 8, 8).collect()}
    assert sorted(k for k, r in found.items() if r["px"] is None) == [1, 5] and {r["more"] for r in found.values()} == {"x"}
    for k in (0, 2, 3, 4, 6, 7):
        px = found[k]["px"]
        assert len(px) == 1600 and set(px) <= {0, 255} and 0 in px and px[: 40 * 8 + 8] == [255] * 328
    with pytest.raises(Exception, match="fewer than 8 by 8"):
        rasters.single_char(one.withColumn("px", F.slice("px", 1, 63)), 8, 8).collect()


def test_no_cell_is_an_expression(spark):
    plan = QUERIES["char_raster"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
