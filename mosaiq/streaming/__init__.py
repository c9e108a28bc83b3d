"""The same columns over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.sources import BINARY_FILE


def stream_webp(spark: SparkSession, path: str, pattern: str = "*.webp", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they come; every function of mosaiq.functions applies unchanged."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)
