"""Incremental detection: new archive files in, results out, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sitemarks.operators.results import detect
from sitemarks.sources.catalog import Catalog


def stream_detect(pages: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """The batch operator as it is: detection is page-local, so it needs no state."""
    return detect(pages, catalog)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what is there and stop; started again with the same checkpoint it resumes after it."""
    return (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
