"""Progress and stalls over a stream of attempts.

The aggregates run in update mode: each micro-batch emits the new state of the
windows it touched, open ones included. ``upsert_files`` keeps these states in files
marked with their batch, and ``latest`` reads the last state of each window, so what is
read is complete at any time and not only when a window has closed. Rows later than the
watermark cannot be counted into a window that has been forgotten; ``late_rows`` says how
many there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sitemarks.operators.runs import STALL_SECONDS, completed_and_failed, gaps_between

WATERMARK = "1 hour"
BATCH = "batch_id"
_ALERT = "run_id string, last_update timestamp, idle_seconds double"


def stream_progress(attempts: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Completed and failed attempts per run and tumbling window, for update mode."""
    return (
        attempts.withWatermark("ts", watermark)
        .groupBy("run_id", F.window("ts", width).alias("w"))
        .agg(*completed_and_failed())
        .select("run_id", F.col("w.start").alias("window_start"), "completed", "failed")
    )


def stream_spans(attempts: DataFrame, threshold_seconds: int = STALL_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """First and last attempt per run and interval of the threshold's length, for update mode.

    Attempts are combined map-side, so the state holds two times per interval however
    many attempts a run makes.
    """
    return (
        attempts.withWatermark("ts", watermark)
        .groupBy("run_id", F.window("ts", f"{threshold_seconds} seconds").alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("run_id", F.col("w.start").alias("interval"), "first_ts", "last_ts")
    )


def stalls_of(spans: DataFrame, threshold_seconds: int = STALL_SECONDS, now: str | None = None) -> DataFrame:
    """Stalls between the latest spans; with ``now`` also those that are still going on."""
    return gaps_between(spans, "interval", "first_ts", "last_ts", threshold_seconds, now)


def upsert_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; each batch's updates replace those of an earlier try of the same batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, schema, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key, by batch. Keys may be null."""
    updates = spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(path)
    last = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    return updates.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", BATCH)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators dropped for being later than the watermark.

    As far back as the session keeps progress reports (``spark.sql.streaming.numRecentProgressUpdates``).
    Rows are counted as the operator meets them: after map-side combine.
    """
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"]
    )


class IdleWatch(StatefulProcessor):
    """State per run: its last event. A processing-time timer fires when nothing follows it."""

    def __init__(self, threshold_seconds: float):
        self.threshold = threshold_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(chunk["ts"].max() for chunk in rows)
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self.last.get() if self.last.exists() else None
        if before is not None:
            newest = max(newest, pd.Timestamp(before[0]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.last.update((newest.to_pydatetime(), now))
        self.handle.registerTimer(now + int(self.threshold * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, seen = self.last.get()
        idle = (timerValues.getCurrentProcessingTimeInMs() - seen) / 1000
        yield pd.DataFrame({"run_id": [key[0]], "last_update": [pd.Timestamp(last)], "idle_seconds": [idle]})

    def close(self) -> None:
        pass


def stream_idle_alerts(attempts: DataFrame, threshold_seconds: float = STALL_SECONDS) -> DataFrame:
    """One row per run and stall, while it lasts: the run made no attempt for the threshold's time.

    Needs the RocksDB state store provider and a continuing trigger, as a timer fires
    in a micro-batch. A run that goes on and stops again is reported again.
    """
    return attempts.select("run_id", "ts").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=IdleWatch(threshold_seconds),
        outputStructType=_ALERT,
        outputMode="Update",
        timeMode="ProcessingTime",
    )
