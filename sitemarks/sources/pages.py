"""Page archives and attempt logs: batch and streaming reads with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitemarks.schemas import ATTEMPT_LOG, PAGE_ARCHIVE


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = PAGE_ARCHIVE) -> DataFrame:
    """The page archive (Parquet, ORC or JSON lines). CSV carries no maps or arrays and is not offered."""
    return spark.read.schema(schema).format(fmt).load(path)


def stream_pages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: str = PAGE_ARCHIVE,
    max_files: int = 1000,
    pattern: str | None = None,
) -> DataFrame:
    """New archive files as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_attempts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(ATTEMPT_LOG).format(fmt).load(path)
