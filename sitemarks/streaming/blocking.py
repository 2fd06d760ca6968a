"""Blocking alerts over a stream of attempts, in event-time order, with a window that each alert empties."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitemarks.operators.blocking import (
    GROUP,
    MIN_RATE,
    ORDER,
    RETRY_QUEUE,
    SHOWN_DOMAINS,
    THRESHOLD,
    WINDOW,
    _ALERT_SCHEMA,
    alert_rows,
    classify_attempts,
)

_WINDOW_STATE = "blocking array<boolean>, domain array<string>, queued bigint"
_PLACE = "first bigint, buckets bigint, part bigint"
_FILED_STATE = "us array<bigint>, attempt_id array<bigint>, is_blocking array<boolean>, domain array<string>"
_FILED = [field.split()[0] for field in _FILED_STATE.split(", ")]
_QUEUE_STATE = "ts timestamp, attempt_id bigint, url string"
_QUEUE_ROWS = "run_id string, egress string, queue_pos int, ts timestamp, attempt_id bigint, url string"
_COLUMNS = [field.split()[0] for field in _ALERT_SCHEMA.split(", ")]
#: Rows later than this are not waited for, unless the caller says otherwise.
DELAY = "1 hour"
#: Rows wait in buckets of so many seconds, and are let go of by whole buckets.
BUCKET_SECONDS = 60
#: So many buckets are filed as one entry of the state, unless they have ``DENSE`` rows each.
SLOT = 60
DENSE = 16
#: Rows are filed, and walked, by so many at a time.
HELD_ROWS = 100_000
#: The time of an end marker: beyond all attempts, and one that tasks can read (nanoseconds end in 2262).
END = "2261-01-01 00:00:00"


def _lists(rows: pd.DataFrame) -> list[list]:
    """The columns of rows as the state takes them."""
    domain = rows["domain"].astype(object)
    return [rows[c].tolist() for c in _FILED[:3]] + [domain.where(domain.notna(), None).tolist()]


class BlockWatch(StatefulProcessor):
    """Alerts of a run and egress in the order of time and id, whatever the order of arrival.

    State: rows that wait until the watermark has passed their bucket; the attempts
    since the last alert that are still in the window (fewer than ``window``); and how many
    were queued for retry. An entry of waiting rows is for one bucket where they are dense, else for a slot
    of buckets, and is only ever added: so entries are few where buckets are many, and none is read to be
    written again but those of the slot that the watermark is in. One timer waits for the
    earliest bucket; it lets go of every bucket that is whole and sets the next.
    """

    def __init__(self, threshold: int, window: int, min_rate: float, queue_size: int, shown_domains: int, bucket_seconds: int):
        self.threshold, self.window, self.min_rate = threshold, window, min_rate
        self.queue_size, self.shown_domains, self.bucket = queue_size, shown_domains, bucket_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", _WINDOW_STATE)
        self.waiting = handle.getMapState("waiting", _PLACE, _FILED_STATE)
        self.filed = handle.getValueState("filed", "parts bigint, earliest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for chunk in rows:  # some chunks at a time: a huge share of a batch is never held whole
            held.append(chunk.loc[~chunk["ends"].astype(bool), _FILED])  # an end marker is no attempt
            n += len(held[-1])
            if n >= HELD_ROWS:
                self._file(held)
                held, n = [], 0
        if n:
            self._file(held)
        return iter(())

    def _file(self, held: list[pd.DataFrame]) -> None:
        rows = pd.concat(held, ignore_index=True).sort_values("us", kind="stable")
        bucket = rows["us"].to_numpy() // self.bucket
        slot = bucket // SLOT
        _, at, size = np.unique(slot, return_inverse=True, return_counts=True)
        buckets = np.bincount(at[np.concatenate([[True], bucket[1:] != bucket[:-1]])])
        dense = (size >= DENSE * buckets)[at]
        first, span = np.where(dense, bucket, slot * SLOT), np.where(dense, 1, SLOT)
        parts, earliest = self._state()
        columns = _lists(rows)
        cuts = (np.flatnonzero(first[1:] != first[:-1]) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(rows)]):
            self.waiting.updateValue((int(first[start]), int(span[start]), parts), tuple(c[start:end] for c in columns))
            parts += 1
        self._wait(parts, earliest, int(bucket[0]))

    def _state(self) -> tuple[int, int | None]:
        return tuple(self.filed.get()) if self.filed.exists() else (0, None)

    def _wait(self, parts: int, earliest: int | None, bucket: int | None) -> None:
        """Note the earliest bucket that waits, and wake up at its end."""
        if bucket is not None and (earliest is None or bucket < earliest):
            earliest = bucket
            self.handle.registerTimer((bucket + 1) * self.bucket // 1000)
        self.filed.update((parts, earliest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts, earliest = self._state()
        until = timerValues.getCurrentWatermarkInMs() * 1000 // self.bucket  # buckets before this one are whole
        if earliest is None or earliest >= until:
            return  # an earlier timer has let go of them
        held, n, left = [], 0, None
        for slot, places in groupby(sorted(self.waiting.keys()), key=lambda place: place[0] // SLOT):
            if slot * SLOT >= until:
                left = slot * SLOT if left is None else left
                break
            places = list(places)
            loose = self._taken([p for p in places if p[1] != 1]).sort_values("us", kind="stable")
            bucket = loose["us"].to_numpy() // self.bucket
            due = int(np.searchsorted(bucket, until))
            if due < len(loose):
                self.waiting.updateValue((slot * SLOT, SLOT, parts), tuple(_lists(loose.iloc[due:])))
                parts, left = parts + 1, int(bucket[due])
            done = 0
            for own, same in groupby([p for p in places if p[1] == 1], key=lambda place: place[0]):
                if own >= until:
                    left = own if left is None else min(left, own)
                    break
                upto = int(np.searchsorted(bucket, own, side="right"))
                held += [loose.iloc[done:upto], self._taken(list(same))]
                done, n = upto, n + upto - done + len(held[-1])
                if n >= HELD_ROWS:
                    yield self._walk(key, held)
                    held, n = [], 0
            held.append(loose.iloc[done:due])
            n += due - done
            if n >= HELD_ROWS:
                yield self._walk(key, held)
                held, n = [], 0
        if n:
            yield self._walk(key, held)
        self._wait(parts, None, left)

    def _taken(self, places: list[tuple]) -> pd.DataFrame:
        """The rows of these entries, which leave the state."""
        columns = [[] for _ in _FILED]
        for place in places:
            for column, more in zip(columns, self.waiting.getValue(place)):
                column.extend(more)
            self.waiting.removeKey(place)
        return pd.DataFrame({name: pd.Series(c, dtype=t) for name, c, t in zip(_FILED, columns, ("int64", "int64", "bool", "object"))})

    def _walk(self, key, held: list[pd.DataFrame]) -> pd.DataFrame:
        new = pd.concat(held, ignore_index=True).rename(columns={"us": "ts"}).sort_values(ORDER, kind="stable")
        state = self.recent.get() if self.recent.exists() else ([], [], 0)
        # Ids and times of these are not looked at; without any, those of the new rows would become floats.
        old = pd.DataFrame({"ts": 0, "attempt_id": 0, "is_blocking": list(state[0]), "domain": list(state[1])})
        halo, queued = len(old), int(state[2])
        both = pd.concat([old, new], ignore_index=True) if halo else new.reset_index(drop=True)
        both["domain"] = both["domain"].astype(object)
        found, reset = alert_rows(
            both, 0, queued, halo, self.threshold, self.window, self.min_rate, self.queue_size, self.shown_domains
        )
        kept = both.iloc[max(reset, len(both) - self.window + 1):]
        queued += int(new["is_blocking"].sum())
        domains = [None if pd.isna(d) else d for d in kept["domain"]]
        self.recent.update(([bool(b) for b in kept["is_blocking"]], domains, min(queued, self.queue_size)))
        found["ts"], found["attempt_id"] = found["ts"].astype("int64"), found["attempt_id"].astype("int64")
        return found.assign(run_id=key[0], egress=key[1])[_COLUMNS]

    def close(self) -> None:
        pass


def stream_block_alerts(
    attempts: DataFrame,
    threshold: int = THRESHOLD,
    window: int = WINDOW,
    min_rate: float = MIN_RATE,
    count_http_status: bool = False,
    queue_size: int = RETRY_QUEUE,
    shown_domains: int = SHOWN_DOMAINS,
    delay: str = DELAY,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Alerts in the order of (ts, attempt_id), as ``block_alerts`` gives them, over any order of arrival.

    An attempt waits until nothing earlier can come any more, which is when the latest time seen is
    ``delay`` beyond its bucket. Later ones are dropped by the watermark and counted by
    ``progress.late_rows``. An attempt without a time is dropped. The last attempts of a log wait for its end marker
    (``end_markers``): a row without ``attempt_id`` and with a time beyond all others.

    Needs the RocksDB state store provider. A task holds ``HELD_ROWS`` rows of a key and what is over of a chunk or one
    bucket; of a slot that has fewer than ``DENSE`` rows a bucket each time it is filed, all that was so filed.
    """
    narrow = classify_attempts(attempts.filter("ts IS NOT NULL").withWatermark("ts", delay), count_http_status)
    # Ids stay integers beside a marker, which has none.
    ends, attempt_id = F.col("attempt_id").isNull(), F.coalesce("attempt_id", F.lit(0).cast("bigint"))
    narrow = narrow.select(
        *GROUP, "ts", attempt_id.alias("attempt_id"), F.unix_micros("ts").alias("us"), "domain", "is_blocking", ends.alias("ends")
    )
    found = narrow.groupBy(*GROUP).transformWithStateInPandas(
        statefulProcessor=BlockWatch(threshold, window, min_rate, queue_size, shown_domains, bucket_seconds),
        outputStructType=_ALERT_SCHEMA.replace("ts timestamp", "ts bigint"),
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.withColumn("ts", F.timestamp_micros("ts"))


def end_markers(attempts: DataFrame, path: str) -> DataFrame:
    """A stream of attempts together with the markers that ``end_log`` writes below ``path``."""
    attempts.sparkSession.createDataFrame([], attempts.schema).write.mode("ignore").parquet(path)
    return attempts.unionByName(attempts.sparkSession.readStream.schema(attempts.schema).parquet(path))


def end_log(attempts: DataFrame, path: str) -> None:
    """Say that all attempts have come: the next run of the stream lets go of what waits."""
    marker = [F.lit(END).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in attempts.schema]
    attempts.sparkSession.range(1).select(*marker).write.mode("append").parquet(path)


class QueueWatch(StatefulProcessor):
    """State per run and egress: the latest blocking attempts, at most ``size``."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", _QUEUE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [*ORDER, "url"]
        held = list(self.queue.get()) if self.queue.exists() else []
        last = pd.DataFrame(held, columns=columns)
        for chunk in rows:  # one chunk at a time: a huge share of a batch is never held whole
            last = pd.concat([last, chunk[columns]]) if len(last) else chunk[columns]
            last = last.sort_values(ORDER).tail(self.size)
        self.queue.put([(t.to_pydatetime(), int(i), u) for t, i, u in last.itertuples(index=False)])
        newest_first = last.iloc[::-1].reset_index(drop=True)
        yield newest_first.assign(run_id=key[0], egress=key[1], queue_pos=newest_first.index + 1)[
            [field.split()[0] for field in _QUEUE_ROWS.split(", ")]
        ]

    def close(self) -> None:
        pass


def stream_retry_queue(attempts: DataFrame, size: int = RETRY_QUEUE, count_http_status: bool = False) -> DataFrame:
    """The retry queue of each run and egress after each micro-batch that adds to it.

    For update mode: position 1 is the latest, and the rows of a later batch replace
    those of an earlier one. Needs the RocksDB state store provider.
    """
    blocking = classify_attempts(attempts, count_http_status).filter("is_blocking")
    return blocking.select(*GROUP, *ORDER, "url").groupBy(*GROUP).transformWithStateInPandas(
        statefulProcessor=QueueWatch(size), outputStructType=_QUEUE_ROWS, outputMode="Update", timeMode="None"
    )
