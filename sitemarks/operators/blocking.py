"""Blocking signals in an attempt log: classification, sliding alerts, alerts with reset, retry queue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.functions.urls import url_domain
from sitemarks.operators.ordered import (
    HALO,
    ROW,
    ROWS_PER_SLICE,
    SEED,
    SLICE,
    join_null_safe,
    slice_rows,
    with_lookback,
)

#: Defaults and what counts as blocking.
THRESHOLD = 5
WINDOW = 20
MIN_RATE = 0.6
RETRY_QUEUE = 50
SHOWN_DOMAINS = 5
BLOCKING_STATUS = (403, 429)
BLOCKING_ERRORS = ("connection reset", "tls", "ssl", "clientconnectorerror", "connectionreseterror")

GROUP = ["run_id", "egress"]
ORDER = ["ts", "attempt_id"]


def is_blocking(success: Column, status_code: Column, error: Column, count_http_status: bool = False) -> Column:
    """Whether an attempt failed the way a block makes it fail.

    ``count_http_status`` also counts answered requests (``success``) whose status is a blocking one.
    """
    by_status = F.coalesce(status_code.isin(*BLOCKING_STATUS), F.lit(False))
    by_error = F.lit(False)
    for text in BLOCKING_ERRORS:
        by_error = by_error | F.contains(F.lower(error), F.lit(text))
    failed = ~F.coalesce(success, F.lit(False)) & (by_status | F.coalesce(by_error, F.lit(False)))
    return (failed | by_status) if count_http_status else failed


def classify_attempts(attempts: DataFrame, count_http_status: bool = False) -> DataFrame:
    """Add ``domain`` and ``is_blocking``."""
    return attempts.withColumns(
        {
            "domain": url_domain("url"),
            "is_blocking": is_blocking(F.col("success"), F.col("status_code"), F.col("error"), count_http_status),
        }
    )


def _narrow(attempts: DataFrame, count_http_status: bool) -> DataFrame:
    return classify_attempts(attempts, count_http_status).select(*GROUP, *ORDER, "domain", "is_blocking")


def block_windows(
    attempts: DataFrame,
    threshold: int = THRESHOLD,
    window: int = WINDOW,
    min_rate: float = MIN_RATE,
    count_http_status: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    queue_size: int = RETRY_QUEUE,
    shown_domains: int = SHOWN_DOMAINS,
) -> DataFrame:
    """Per attempt, the alert state over the last ``window`` attempts of its run and egress (no reset).

    Statistics are NULL below the threshold. An alert names ``shown_domains`` domains at
    most, and counts a retry queue that holds ``queue_size`` URLs at most.
    """
    narrow = _narrow(attempts, count_http_status)
    blocked = F.col("is_blocking").cast("int")
    sliced = slice_rows(narrow, GROUP, ORDER, rows_per_slice)
    rows = with_lookback(sliced, GROUP, ORDER, window - 1, {"_blocked": blocked})
    in_slice = Window.partitionBy(*GROUP, SLICE).orderBy("_kind", *ORDER)
    frame = in_slice.rowsBetween(1 - window, 0)
    upto = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    queued = F.when(F.col("_kind") == SEED, F.col("_blocked_before")).when(F.col("_kind") == ROW, blocked)
    df = rows.select(
        *GROUP,
        *ORDER,
        "domain",
        "is_blocking",
        "_kind",
        F.count("is_blocking").over(frame).alias("total_attempts"),
        F.coalesce(F.sum(blocked).over(frame), F.lit(0)).alias("blocking_failures"),
        F.collect_list(F.when(F.col("is_blocking"), F.col("domain"))).over(frame).alias("_domains"),
        F.sum(queued).over(upto).alias("_queued"),
    ).filter(F.col("_kind") == ROW)
    recent = F.slice("_domains", F.greatest(F.lit(1), F.size("_domains") - (threshold - 1)), threshold)
    df = df.withColumn("_recent", F.array_sort(F.array_distinct(recent)))
    enough = F.col("blocking_failures") >= threshold
    rate = F.col("blocking_failures") / F.col("total_attempts")
    return df.select(
        *GROUP,
        *ORDER,
        "domain",
        "is_blocking",
        "total_attempts",
        "blocking_failures",
        F.when(enough, rate).alias("blocking_rate"),
        F.when(enough, F.size("_recent")).alias("unique_domains"),
        F.when(enough, F.slice("_recent", 1, shown_domains)).alias("affected_domains"),
        F.when(enough, F.least(F.col("_queued"), F.lit(queue_size))).alias("retry_queue_size"),
        (enough & (F.size("_recent") >= 2) & (rate >= min_rate)).alias("is_blocked"),
    )


def retry_queue(attempts: DataFrame, size: int = RETRY_QUEUE, count_http_status: bool = False) -> DataFrame:
    """The last ``size`` blocking attempts per run and egress, ``queue_pos`` 1 = latest.

    The rank limit is applied by each task before the shuffle, so a huge group ships at most ``size`` rows per task.
    """
    latest = Window.partitionBy(*GROUP).orderBy(*[F.col(c).desc() for c in ORDER])
    blocking = classify_attempts(attempts, count_http_status).filter("is_blocking")
    return (
        blocking.select(*GROUP, *ORDER, "url")
        .withColumn("queue_pos", F.row_number().over(latest))
        .filter(F.col("queue_pos") <= size)
    )


# --- alerts with reset ------------------------------------------------------------------------------
#
# After an alert the window is emptied, so what happens next depends on when the last alert was. Reset
# points are positions between rows: position p means "emptied after the first p rows". For every p the
# position of the next alert can be computed from the rows around it; alerts are the chain of these
# jumps. A slice that does not know where the last alert before it was has only ``window`` cases (how
# many of the rows before it are still in the window), so each slice is summarised by a table of that
# many entries; chaining these small tables yields the true entry state of every slice.


def next_alerts(
    blocking: np.ndarray, domain: np.ndarray, halo: int, threshold: int, window: int, min_rate: float
) -> np.ndarray:
    """For every reset position 0..n, the position of the next alert (n + 1 when there is none).

    The first ``halo`` rows only fill windows; alerts on them belong to an earlier slice.
    """
    n = len(blocking)
    none = n + 1
    before = np.concatenate([[0], np.cumsum(blocking)])
    # Attempts without a domain count as failures but name no domain.
    named = blocking & pd.notna(domain)
    named_before = np.concatenate([[0], np.cumsum(named)])
    codes = pd.factorize(domain[named])[0]
    start_of_run = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, bool)
    last_start = np.maximum.accumulate(np.where(start_of_run, np.arange(len(codes)), 0)) if len(codes) else codes
    # run[k]: how many of the last named rows among the first k have one domain
    run = np.concatenate([[0], np.arange(len(codes)) - last_start + 1])[named_before]

    def fires(length: int) -> np.ndarray:
        """For every end of a window of this length, whether it raises an alert."""
        count = before[length:] - before[:-length]
        seen = np.minimum(named_before[length:] - named_before[:-length], threshold)
        own = (count >= threshold) & (run[length:] < seen) & (count / length >= min_rate)
        return own & (np.arange(length, n + 1) > halo)

    nxt = np.full(n + 1, none)
    if n >= window:
        at = np.where(fires(window), np.arange(window, n + 1), none)
        nxt[: n - window + 1] = np.minimum.accumulate(at[::-1])[::-1]
    for length in range(min(window - 1, n), 0, -1):
        at = np.flatnonzero(fires(length))
        nxt[at] = at + length
    return nxt


def _prepared(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, pd.DataFrame]:
    rows = group[group["_kind"] != SEED].sort_values(["_kind", *ORDER], kind="stable")
    return (
        rows["is_blocking"].to_numpy(dtype=bool),
        rows["domain"].to_numpy(dtype=object),
        int((rows["_kind"] == HALO).sum()),
        rows,
    )


def _exit_states(window: int, threshold: int, min_rate: float):
    """Per slice: state at its end for each state at its start (rows still in the window)."""

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        blocking, domain, halo, _ = _prepared(group)
        n = len(blocking)
        jump = next_alerts(blocking, domain, halo, threshold, window, min_rate)
        end = np.where(jump > n, np.arange(n + 1), jump)
        while True:  # pointer doubling: where the chain of alerts from each position ends
            further = end[end]
            if (further == end).all():
                break
            end = further
        starts = [max(halo - state, 0) for state in range(window)]
        exits = [int(min(window - 1, n - end[p])) for p in starts]
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in [*GROUP, SLICE]}, "exits": [exits]})

    return summarise


def _entry_states(table: pd.DataFrame) -> pd.DataFrame:
    """Chain the slice tables of one run and egress: the state each slice starts with."""
    table = table.sort_values(SLICE)
    state, states = 0, []
    for exits in table["exits"]:
        states.append(state)
        state = int(exits[state])
    return table[[*GROUP, SLICE]].assign(entry=states)


_ALERT_SCHEMA = (
    "run_id string, egress string, attempt_id bigint, ts timestamp, blocking_failures int, total_attempts int, "
    "blocking_rate double, unique_domains int, affected_domains array<string>, retry_queue_size int"
)


def alert_rows(
    rows: pd.DataFrame,
    start: int,
    queued: int,
    halo: int,
    threshold: int,
    window: int,
    min_rate: float,
    queue_size: int = RETRY_QUEUE,
    shown_domains: int = SHOWN_DOMAINS,
) -> tuple[pd.DataFrame, int]:
    """Alerts met when walking ordered rows from a reset position, and the last reset position.

    A NULL domain is none: its attempt counts, but it is not among the domains.

    ``queued`` counts the blocking attempts before the first row that is not halo.
    """
    blocking = rows["is_blocking"].to_numpy(dtype=bool)
    domain = rows["domain"].to_numpy(dtype=object)
    named = blocking & pd.notna(domain)
    n = len(rows)
    jump = next_alerts(blocking, domain, halo, threshold, window, min_rate)
    before = np.concatenate([[0], np.cumsum(blocking)])
    found, p = [], start
    while jump[p] <= n:
        at = int(jump[p])
        first = max(p, at - window)
        recent = domain[first:at][named[first:at]][-threshold:]
        names = sorted(set(recent))
        failures = int(before[at] - before[first])
        found.append(
            {
                "attempt_id": rows["attempt_id"].iloc[at - 1],
                "ts": rows["ts"].iloc[at - 1],
                "blocking_failures": failures,
                "total_attempts": at - first,
                "blocking_rate": failures / (at - first),
                "unique_domains": len(names),
                "affected_domains": names[:shown_domains],
                "retry_queue_size": int(min(queue_size, queued + before[at] - before[halo])),
            }
        )
        p = at
    columns = ["attempt_id", "ts", "blocking_failures", "total_attempts", "blocking_rate", "unique_domains",
               "affected_domains", "retry_queue_size"]
    return pd.DataFrame(found, columns=columns), p


def _alerts(window: int, threshold: int, min_rate: float, queue_size: int, shown_domains: int):
    def emit(group: pd.DataFrame) -> pd.DataFrame:
        seed = group[group["_kind"] == SEED].iloc[0]
        _, _, halo, rows = _prepared(group)
        start = max(halo - int(seed["entry"]), 0)
        found, _ = alert_rows(rows, start, int(seed["_blocked_before"]), halo, threshold, window, min_rate, queue_size, shown_domains)
        return found.assign(run_id=seed["run_id"], egress=seed["egress"])

    return emit


def block_alerts(
    attempts: DataFrame,
    threshold: int = THRESHOLD,
    window: int = WINDOW,
    min_rate: float = MIN_RATE,
    count_http_status: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    queue_size: int = RETRY_QUEUE,
    shown_domains: int = SHOWN_DOMAINS,
) -> DataFrame:
    """Alerts per run and egress when each alert empties the window (the retry queue is kept).

    Sequential by nature, yet no group is walked by one task: see the note above.
    """
    narrow = _narrow(attempts, count_http_status)
    sliced = slice_rows(narrow, GROUP, ORDER, rows_per_slice)
    rows = with_lookback(sliced, GROUP, ORDER, window - 1, {"_blocked": F.col("is_blocking").cast("int")})
    keys = [*GROUP, SLICE]
    key_ddl = f"run_id string, egress string, {SLICE} int"
    exits = rows.groupBy(*keys).applyInPandas(
        _exit_states(window, threshold, min_rate), f"{key_ddl}, exits array<int>"
    )
    entries = exits.groupBy(*GROUP).applyInPandas(_entry_states, f"{key_ddl}, entry int")
    seeds = join_null_safe(rows.filter(F.col("_kind") == SEED), entries, keys)
    ready = rows.filter(F.col("_kind") != SEED).unionByName(seeds, allowMissingColumns=True)
    return ready.groupBy(*keys).applyInPandas(
        _alerts(window, threshold, min_rate, queue_size, shown_domains), _ALERT_SCHEMA
    )
