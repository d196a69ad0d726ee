"""Pixel operators on small grayscale tiles (array columns of 64 values, 8 by 8), with array functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 8


def tiles(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, px: 64 gray levels from the components."""
    return embeddings.select("vec_id", "label", F.transform("embedding", lambda v: F.expr("CAST(0 AS INT)") + F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v.cast("double") + 0.5) * 255)).cast("int")).alias("px"))


def edge(px: str = "px") -> str:
    """Mean absolute difference along rows plus that along columns."""
    across = f"aggregate(sequence(0, 63), 0, (s, k) -> s + IF(k % {SIDE} = 0, 0, abs({px}[k] - {px}[k - 1])))"
    down = f"aggregate(sequence({SIDE}, 63), 0, (s, k) -> s + abs({px}[k] - {px}[k - {SIDE}]))"
    return f"({across}) / 56D + ({down}) / 56D"


def luma(red: str, green: str, blue: str) -> str:
    """Gray levels of three arrays, as SQL, in ten-thousandths: whole numbers, so that sums don't depend on their order."""
    return f"transform({red}, (v, k) -> CAST(2989 * v + 5870 * {green}[k] + 1140 * {blue}[k] AS BIGINT))"


def dark(found: DataFrame, least: int, below: int = 128) -> DataFrame:
    """vec_id, n_dark (pixels below a level), enough (at least so many of them)."""
    return found.selectExpr("vec_id", f"size(filter(px, v -> v < {below})) AS n_dark").withColumn("enough", F.col("n_dark") >= least)


def level(found: DataFrame) -> DataFrame:
    """vec_id, mean, sd (population), preset: dark tiles, tiles of strong contrast, and clean ones."""
    s, q = "aggregate(px, 0L, (a, v) -> a + v)", "aggregate(px, 0L, (a, v) -> a + CAST(v AS BIGINT) * v)"
    found = found.selectExpr("vec_id", f"{s} AS s", f"{q} AS q")
    found = found.selectExpr("vec_id", "round(s / 64D, 6) AS mean", "round(sqrt(CAST(64 * q - s * s AS DOUBLE)) / 64D, 6) AS sd")
    return found.withColumn("preset", F.expr("CASE WHEN mean < 110 THEN 'low_light' WHEN sd > 75 THEN 'photo' ELSE 'clean_doc' END"))


def at(dy: int, dx: int) -> str:
    """The pixel beside k, edges repeated."""
    return f"px[CAST(least(7, greatest(0, k div 8 + ({dy}))) * 8 + least(7, greatest(0, k % 8 + ({dx}))) AS INT)]"


def median3(found: DataFrame) -> DataFrame:
    """vec_id, px after a 3 by 3 median."""
    near = ", ".join(at(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1))
    return found.select("vec_id", F.expr(f"transform(sequence(0, 63), k -> sort_array(array({near}))[4])").alias("px"))


def sharpen(found: DataFrame) -> DataFrame:
    """vec_id, px after a 3 by 3 sharpening kernel, clipped to 0..255."""
    return found.select("vec_id", F.expr(f"transform(sequence(0, 63), k -> least(255, greatest(0, 5 * px[k] - {at(-1, 0)} - {at(1, 0)} - {at(0, -1)} - {at(0, 1)})))").alias("px"))


def scaled(width: str, height: str, factor: str) -> list[str]:
    """Both sides times a factor, truncated."""
    return [f"CAST({width} * {factor} AS INT) AS new_w", f"CAST({height} * {factor} AS INT) AS new_h"]
