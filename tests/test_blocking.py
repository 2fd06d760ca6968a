"""Blocking operators against a plain walk over the attempts, with slices far smaller than in use."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitemarks.operators import blocking as b
from sitemarks.operators import ordered

START = datetime(2024, 5, 1)
SCHEMA = (
    "run_id string, egress string, attempt_id long, ts timestamp, url string, success boolean, status_code int, error string"
)


def log(seed, rows, egresses, domains, blocking_share, run="r"):
    """Random attempts; ``blocking_share`` varies over time so that alerts come and go."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        bad = rng.random() < blocking_share * (1 if (i // 150) % 2 else 0.4)
        at = START + timedelta(seconds=i // 3)  # ties in time
        egress = rng.choice(egresses)
        out.append(
            (run, None if egress is None else str(egress), i, at, f"https://d{rng.randrange(domains)}.com/p{i}", not bad, 403 if bad else 200, None)
        )
    return out


def walk(rows, threshold=5, window=20, rate=0.6, reset=True):
    """All alert states by walking each egress in order."""
    out = {}
    for egress in {r[1] for r in rows}:
        recent, queued = deque(maxlen=window), 0
        for r in sorted((r for r in rows if r[1] == egress), key=lambda r: (r[3], r[2])):
            bad = not r[5]
            queued += bad
            recent.append((r[4].split("/")[2], bad))
            domains = [d for d, x in recent if x]
            last = sorted(set(domains[-threshold:]))
            fires = len(domains) >= threshold and len(last) >= 2 and len(domains) / len(recent) >= rate
            out[r[2]] = (fires, len(domains), len(recent), len(last), last[:5], min(50, queued))
            if fires and reset:
                recent.clear()
    return out


CASES = [
    dict(seed=1, rows=900, egresses=[1], domains=6, blocking_share=0.9),
    dict(seed=2, rows=900, egresses=[1, 1, 1, 1, 2], domains=2, blocking_share=0.75),
    dict(seed=3, rows=300, egresses=range(60), domains=3, blocking_share=1.0),
    dict(seed=4, rows=700, egresses=[1, 2], domains=1, blocking_share=1.0),
    dict(seed=6, rows=500, egresses=[None, None, 1], domains=5, blocking_share=0.9),
    dict(seed=7, rows=300, egresses=[None], domains=4, blocking_share=0.9, run=None),
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rows_per_slice", [10, 1_000_000])
def test_windows_equal_a_walk(spark, case, rows_per_slice):
    rows = log(**case)
    df = b.block_windows(spark.createDataFrame(rows, SCHEMA), rows_per_slice=rows_per_slice)
    wanted = walk(rows, reset=False)
    got = {r.attempt_id: r for r in df.collect()}
    assert got.keys() == wanted.keys()
    for i, (fires, failures, total, unique, names, queued) in wanted.items():
        r = got[i]
        assert (r.is_blocked, r.blocking_failures, r.total_attempts) == (fires, failures, total)
        if failures >= 5:
            assert (r.unique_domains, r.affected_domains, r.retry_queue_size) == (unique, names, queued)
        else:
            assert r.blocking_rate is None and r.affected_domains is None


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rows_per_slice", [7, 60, 1_000_000])
def test_alerts_with_reset_equal_a_walk(spark, case, rows_per_slice):
    rows = log(**case)
    df = b.block_alerts(spark.createDataFrame(rows, SCHEMA), rows_per_slice=rows_per_slice)
    got = {
        r.attempt_id: (r.blocking_failures, r.total_attempts, r.unique_domains, r.affected_domains, r.retry_queue_size)
        for r in df.collect()
    }
    assert got == {i: w[1:] for i, w in walk(rows).items() if w[0]}


def test_sizes_are_parameters(spark):
    rows = log(seed=8, rows=300, egresses=[1], domains=40, blocking_share=1.0)
    df = spark.createDataFrame(rows, SCHEMA)
    for got in (
        b.block_alerts(df, threshold=8, queue_size=500, shown_domains=8, rows_per_slice=40),
        b.block_windows(df, threshold=8, queue_size=500, shown_domains=8, rows_per_slice=40).filter("is_blocked"),
    ):
        found = got.collect()
        assert max(len(r.affected_domains) for r in found) > 5
        assert all(len(r.affected_domains) == r.unique_domains for r in found)
        assert max(r.retry_queue_size for r in found) > 50


@pytest.mark.parametrize("threshold, window, rate", [(1, 5, 0.1), (2, 4, 0.5), (3, 8, 1.0), (6, 6, 0.9)])
def test_alert_parameters(spark, threshold, window, rate):
    rows = log(seed=5, rows=400, egresses=[1], domains=3, blocking_share=0.9)
    df = b.block_alerts(spark.createDataFrame(rows, SCHEMA), threshold, window, rate, rows_per_slice=30)
    assert sorted(r.attempt_id for r in df.collect()) == sorted(
        i for i, w in walk(rows, threshold, window, rate).items() if w[0]
    )


@pytest.mark.parametrize(
    "success, status, error, blocking",
    [
        (False, 403, None, True),
        (False, 429, None, True),
        (False, 404, None, False),
        (False, 404, "TLS handshake failed", True),
        (False, None, "Connection reset by peer", True),
        (False, None, "Request timeout", False),
        (False, None, "ClientConnectorError(...)", True),
        (False, 500, None, False),
        (True, 403, None, False),
        (True, 200, "ssl", False),
    ],
)
def test_classification(spark, success, status, error, blocking):
    df = spark.createDataFrame([("r", "1", 1, START, "https://U@e.com:81/x", success, status, error)], SCHEMA)
    row = b.classify_attempts(df).first()
    assert (row.is_blocking, row.domain) == (blocking, "U@e.com:81")
    assert b.classify_attempts(df, count_http_status=True).first().is_blocking == (blocking or status in (403, 429))


def test_retry_queue_keeps_the_last_fifty(spark):
    rows = [("r", "1", i, START + timedelta(seconds=i), f"https://e{i}.com", False, 403, None) for i in range(60)]
    got = b.retry_queue(spark.createDataFrame(rows, SCHEMA)).orderBy("queue_pos").collect()
    assert [r.attempt_id for r in got] == list(range(59, 9, -1))


@pytest.mark.parametrize("rows_per_slice", [5, 1000])
def test_running_totals_and_look_back(spark, rows_per_slice):
    rng = random.Random(9)
    rows = [(rng.choice("aaaaaaab"), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = ordered.with_running_totals(df, ["g"], ["o"], {"n": F.lit(1), "s": F.col("v")}, rows_per_slice).collect()
    for g in "ab":
        n = s = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.o):
            n, s = n + 1, s + r.v
            assert (r.n, r.s) == (n, s)
    assert len(got) == len(rows)
    sliced = ordered.slice_rows(df, ["g"], ["o"], rows_per_slice)
    ready = ordered.with_lookback(sliced, ["g"], ["o"], 12).collect()
    slices = {}
    for r in ready:
        slices.setdefault((r.g, r.slice_no), {}).setdefault(r._kind, []).append(r.o)
    for (g, _), kinds in slices.items():
        before = sorted(o for x, o, _ in rows if x == g and o < min(kinds[ordered.ROW]))
        assert sorted(kinds.get(ordered.HALO, [])) == before[-12:]
        assert len(kinds[ordered.SEED]) == 1
