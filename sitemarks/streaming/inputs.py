"""Duplicate suppression over a stream of input URLs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_dedup(urls: DataFrame, time_column: str = "ts", within: str | None = None) -> DataFrame:
    """Pass each URL on once.

    Without a bound every URL is remembered, one row of keyed state each, and none is late:
    any order of arrival gives the distinct URLs. Keep that state in RocksDB, so that it grows on disk. With
    ``within`` the state is bounded: a URL passes once within that time, and rows later
    than it are dropped and counted by ``progress.late_rows``. NULL is a URL of its own.
    """
    if within is None:
        return urls.dropDuplicates(["original_url"])
    return urls.withWatermark(time_column, within).dropDuplicatesWithinWatermark(["original_url"])


class Seen(StatefulProcessor):
    """State per URL: that it was passed on, forgotten after a time."""

    def __init__(self, forget_after_ms: int, order: str, columns: list[str]):
        self.forget_after_ms, self.order, self.columns = forget_after_ms, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.forget_after_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        first = pd.DataFrame()
        for chunk in rows:  # one chunk at a time, however often a URL comes
            both = pd.concat([first, chunk]) if len(first) else chunk
            first = both.sort_values(self.order, kind="stable").head(1)
        self.seen.update((True,))
        yield first[self.columns]

    def close(self) -> None:
        pass


def stream_dedup_for(urls: DataFrame, forget_after_seconds: float, time_column: str = "ts") -> DataFrame:
    """Pass each URL on once, and again after a time of processing has passed since.

    No row is late, whatever its own time; the state is bounded by the URLs of that time. Of a
    micro-batch's rows of a URL the earliest passes. Needs the RocksDB state store provider.
    """
    return urls.withColumn("_key", F.col("original_url")).groupBy("_key").transformWithStateInPandas(
        statefulProcessor=Seen(int(forget_after_seconds * 1000), time_column, urls.columns),
        outputStructType=urls.schema,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
