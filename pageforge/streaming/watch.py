"""An extension: the batch plan over a folder that is watched. Each new file is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.operators.extract import dispatch


def watch(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of doc, input_type, content for files of allowed types that arrive under path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    named = dispatch(found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content"))
    return named.where("allowed").select(F.col("filename").alias("doc"), "input_type", "content")
