"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "pageforge", cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    built = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    return built
