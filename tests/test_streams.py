"""Streams over several micro-batches give what the batch operators give."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_blocking import SCHEMA, log, walk

from sitemarks.operators.blocking import alert_rows, block_alerts, retry_queue
from sitemarks.operators.results import detect, failure_results, json_results
from sitemarks.operators.runs import progress_by_window, progress_snapshots, run_statistics, stall_gaps
from sitemarks.operators.url_prep import dedup_urls
from sitemarks.sources.pages import stream_pages
from sitemarks.streaming import blocking, progress, sinks
from sitemarks.streaming.blocking import end_log, end_markers, stream_block_alerts, stream_retry_queue
from sitemarks.streaming.detection import run_to_files, stream_detect
from sitemarks.streaming.inputs import stream_dedup, stream_dedup_for

LOADER = '<script id="hs-script-loader" src="//js.hs-scripts.com/906713.js"></script>'


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, tmp_path, name="out"):
    run_to_files(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def _alerts(spark, tmp_path, files, **parameters):
    """Alerts of a log that comes file by file, one a micro-batch, and then ends."""
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    attempts = source(spark, tmp_path / "log", SCHEMA)
    stream = stream_block_alerts(end_markers(attempts, str(tmp_path / "end")), **parameters)
    first = drain(stream, tmp_path).count()
    end_log(attempts, str(tmp_path / "end"))
    return drain(stream, tmp_path).collect(), first


def _texts(rows):
    return {
        (r.egress, r.attempt_id): (r.ts, r.blocking_failures, r.total_attempts, r.unique_domains, r.affected_domains, r.retry_queue_size)
        for r in rows
    }


def test_alerts_over_micro_batches(spark, tmp_path):
    rows = log(seed=11, rows=400, egresses=[1, 1, 2], domains=4, blocking_share=0.9)
    got, _ = _alerts(spark, tmp_path, [rows[i : i + 130] for i in range(0, 400, 130)])
    assert {
        r.attempt_id: (r.blocking_failures, r.total_attempts, r.unique_domains, r.affected_domains, r.retry_queue_size)
        for r in got
    } == {i: w[1:] for i, w in walk(rows).items() if w[0]}


def test_alerts_follow_event_time_over_shuffled_files(spark, tmp_path):
    rows = [list(r) for r in log(seed=5, rows=600, egresses=[1, 1, 2, None], domains=4, blocking_share=0.9)]
    rng = random.Random(7)
    for r in rows:
        r[3] += (r[2] // 3) * timedelta(seconds=30)  # 100 minutes in all
        r[4] = None if rng.random() < 0.1 else r[4]
    late = sorted(rows, key=lambda r: r[3] + timedelta(minutes=rng.uniform(0, 50)))  # up to 50 minutes out of order
    got, first = _alerts(spark, tmp_path, [late[i : i + 60] for i in range(0, 600, 60)], bucket_seconds=45)
    expected = _texts(block_alerts(spark.createDataFrame(list(map(tuple, rows)), SCHEMA), rows_per_slice=100).collect())
    assert len(expected) > 5 and _texts(got) == expected and len(got) == len(expected)
    assert 0 < first < len(got)  # some came before the end of the log


def test_attempts_beyond_the_delay_are_counted(spark, tmp_path):
    rows = log(seed=3, rows=90, egresses=[1], domains=4, blocking_share=0.9)
    old = [(*r[:2], 1000 + i, r[3] - timedelta(hours=3), *r[4:]) for i, r in enumerate(rows[:7])]
    for part in (rows[:60], rows[60:], old):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = stream_block_alerts(source(spark, tmp_path / "log", SCHEMA))
    query = run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert progress.late_rows(query) == 7


def test_one_egress_in_one_file(spark, tmp_path):
    """Many rows of one key come in one batch; state and tasks hold them by bucket."""
    rows = log(seed=2, rows=20_000, egresses=[1], domains=5, blocking_share=0.8)
    r = random.Random(1)
    shuffled = r.sample(rows, len(rows))
    got, _ = _alerts(spark, tmp_path, [shuffled])
    assert _texts(got) == _texts(block_alerts(spark.createDataFrame(rows, SCHEMA)).collect())


def test_detection_resumes_after_what_is_done(spark, page_table, tmp_path):
    pages = page_table(LOADER, "", LOADER)
    pages.filter("page_id < 2").write.parquet(str(tmp_path / "archive"))
    for expected in (2, 2):
        stream = stream_detect(stream_pages(spark, str(tmp_path / "archive"), max_files=1))
        assert drain(stream, tmp_path).count() == expected
    pages.filter("page_id = 2").write.mode("append").parquet(str(tmp_path / "archive"))
    out = drain(stream_detect(stream_pages(spark, str(tmp_path / "archive"))), tmp_path)
    assert sorted(map(str, out.collect())) == sorted(map(str, detect(pages).collect()))


def test_duplicates_within_the_bound(spark, tmp_path):
    for i, url in enumerate(["a", "b", "a"]):
        row = [(datetime(2024, 5, 1, 10, i), url)]
        spark.createDataFrame(row, "ts timestamp, original_url string").write.mode("append").parquet(str(tmp_path / "urls"))
    out = drain(stream_dedup(source(spark, tmp_path / "urls", "ts timestamp, original_url string")), tmp_path)
    assert sorted(r.original_url for r in out.collect()) == ["a", "b"]


ATTEMPTS = "run_id string, ts timestamp, success boolean, original_url string"


def scattered(spark, tmp_path, files=6):
    """Attempts of two runs and of none, out of order over several files; some outcomes are unknown."""
    rng = random.Random(4)
    rows = [
        (rng.choice(["a", "b", None]), datetime(2024, 5, 1) + timedelta(minutes=rng.randrange(3000)), rng.choice([True, False, None]), f"u{i}")
        for i in range(400)
    ]
    for i in range(files):
        spark.createDataFrame(rows[i::files], ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.createDataFrame(rows, ATTEMPTS), source(spark, tmp_path / "log", ATTEMPTS)


def upserted(stream, tmp_path, keys):
    query = progress.upsert_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress}) > 5
    return progress.latest(stream.sparkSession, stream.schema, str(tmp_path / "out"), keys), query


def test_progress_over_scattered_files_is_complete(spark, tmp_path):
    batch, stream = scattered(spark, tmp_path)
    got, query = upserted(progress.stream_progress(stream, watermark="10 days"), tmp_path, ["run_id", "window_start"])
    wanted = progress_by_window(batch).select("run_id", "window_start", "completed", "failed")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert progress.late_rows(query) == 0
    assert got.selectExpr("sum(completed + failed)").first()[0] == batch.count()


def test_late_rows_are_counted(spark, tmp_path):
    for day in (5, 9, 1):
        rows = [("a", datetime(2024, 5, day, h), True, "u") for h in (1, 2)]
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = progress.stream_progress(source(spark, tmp_path / "log", ATTEMPTS))
    query = progress.upsert_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert progress.late_rows(query) == 2


def test_stalls_over_scattered_files_are_complete(spark, tmp_path):
    batch, stream = scattered(spark, tmp_path)
    spans, _ = upserted(progress.stream_spans(stream, watermark="10 days"), tmp_path, ["run_id", "interval"])
    for now in (None, "2024-05-09 00:00:00"):
        got = progress.stalls_of(spans, now=now).collect()
        assert sorted(map(str, got)) == sorted(map(str, stall_gaps(batch, now=now).collect()))
        assert got


def test_a_run_that_stops_is_reported_while_it_is_silent(spark, tmp_path):
    spark.createDataFrame([("a", datetime(2024, 5, 1), True, "u")], ATTEMPTS).write.parquet(str(tmp_path / "log"))
    alerts = progress.stream_idle_alerts(source(spark, tmp_path / "log", ATTEMPTS), threshold_seconds=3)
    query = alerts.writeStream.format("memory").queryName("idle").outputMode("update").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("idle").count():
            time.sleep(1)
        row = spark.table("idle").first()
    finally:
        query.stop()
    assert (row.run_id, row.last_update) == ("a", datetime(2024, 5, 1)) and row.idle_seconds >= 3


def test_retry_queue_over_micro_batches(spark, tmp_path):
    rows = log(seed=12, rows=500, egresses=[1, 1, 2, None], domains=4, blocking_share=0.9)
    random.Random(1).shuffle(rows)
    for i in range(6):
        spark.createDataFrame(rows[i::6], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = stream_retry_queue(source(spark, tmp_path / "log", SCHEMA))
    got, _ = upserted(stream, tmp_path, ["run_id", "egress", "queue_pos"])
    columns = ["egress", "queue_pos", "attempt_id", "url"]
    wanted = retry_queue(spark.createDataFrame(rows, SCHEMA)).select(*columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, wanted.collect()))


def test_an_unknown_outcome_is_a_failure(spark):
    rows = [(None, datetime(2024, 5, 1), None, "x"), ("a", datetime(2024, 5, 1), True, "y")]
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    assert [r.original_url for r in failure_results(attempts).collect()] == ["x"]
    assert sorted((r.completed, r.failed) for r in progress_by_window(attempts).collect()) == [(0, 1), (1, 0)]


def test_snapshots_of_runs_without_a_name(spark, page_table):
    from pyspark.sql import functions as F

    runs = detect(page_table(*[LOADER] * 7)).withColumn("original_url", F.concat("original_url", F.col("page_id").cast("string")))
    runs = runs.withColumn("run_id", F.when(F.col("page_id") > 3, "r")).withColumn("fetched_at", F.when(F.col("page_id") != 1, F.col("fetched_at")))
    got = progress_snapshots(runs, every=2, total_urls=100).collect()
    assert sorted((r.run_id or "", r.completed, r.unique_hub_ids) for r in got) == [("", 2, 1), ("", 4, 1), ("r", 2, 1), ("r", 3, 1)]


def test_dedup_without_a_bound_loses_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(datetime(2024, 5, 1) + timedelta(days=rng.randrange(400)), rng.choice([None, *[f"u{k}" for k in range(60)]])) for _ in range(300)]
    for i in range(0, 300, 50):
        spark.createDataFrame(rows[i : i + 50], "ts timestamp, original_url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "urls"))
    stream = stream_dedup(source(spark, tmp_path / "urls", "ts timestamp, original_url string"))
    got = [r.original_url for r in drain(stream, tmp_path).collect()]
    batch = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(rows)], "input_pos int, original_url string")
    assert sorted(got, key=str) == sorted((r.original_url for r in dedup_urls(batch).collect()), key=str)


def test_dedup_that_forgets(spark, tmp_path):
    times = [datetime(2024, 5, 1, 10, 5), datetime(2020, 5, 1), datetime(2024, 5, 1, 10, 1), datetime(2024, 5, 2)]
    schema, log_path = "ts timestamp, original_url string", str(tmp_path / "urls")

    def once(name, seconds):
        # One batch a run: a stream with processing time has no last batch by itself.
        stream = stream_dedup_for(spark.readStream.schema(schema).parquet(log_path), seconds)
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
        writer.trigger(once=True).start().awaitTermination(90)
        return sorted(((r.original_url, r.ts) for r in spark.read.schema(schema).parquet(str(tmp_path / name)).collect()), key=str)

    spark.createDataFrame([(times[0], "a"), (times[2], "a"), (times[0], "b"), (times[0], None)], schema).write.mode("append").parquet(log_path)
    first = sorted([("a", times[2]), ("b", times[0]), (None, times[0])], key=str)
    assert once("long", 3600) == first and once("short", 0.001) == first
    spark.createDataFrame([(times[1], "a"), (times[3], "c")], schema).write.mode("append").parquet(log_path)  # one of them long past
    assert once("long", 3600) == sorted([*first, ("c", times[3])], key=str)
    assert once("short", 0.001) == sorted([*first, ("c", times[3]), ("a", times[1])], key=str)


def test_three_sinks_after_a_stop_between_any_two(spark, page_table, tmp_path, monkeypatch):
    """A run that breaks off after each of the outputs in turn, and goes on: every row once, counters as in one pass."""
    pages = page_table(*[{"original_url": f"u{i}.com", "html": LOADER if i % 2 else ""} for i in range(12)])
    for i in range(0, 12, 4):
        pages.filter(f"page_id >= {i} AND page_id < {i + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "archive"))
    stream = stream_detect(stream_pages(spark, str(tmp_path / "archive"), max_files=1))
    stream = stream.withColumn("error", F.when(F.col("page_id") % 3 == 0, "no answer"))
    place, stops = sinks._place, iter([sinks.LINES, sinks.COMPLETED, sinks.COMMITS, sinks.FAILED])
    stop = next(stops)

    def breaking(folder, output, batch_id):
        nonlocal stop
        if output == stop:
            stop = next(stops, None)
            raise RuntimeError("broken off here")
        return place(folder, output, batch_id)

    monkeypatch.setattr(sinks, "_place", breaking)
    folder, broken = str(tmp_path / "out"), 0
    for _ in range(5):
        try:
            sinks.run_to_sinks(stream, folder, str(tmp_path / "state")).awaitTermination()
        except StreamingQueryException as error:
            assert "broken off here" in str(error)
            broken += 1
    assert broken == 4
    results = sinks.read_committed(spark, folder, sinks.RESULTS, stream.schema)
    whole = detect(pages).withColumn("error", F.when(F.col("page_id") % 3 == 0, "no answer"))
    assert sorted(map(str, results.collect())) == sorted(map(str, whole.collect()))
    texts = lambda output: sorted(r.value for r in sinks.read_committed(spark, folder, output).collect())
    assert texts(sinks.LINES) == sorted(r.value for r in json_results(whole).collect())
    assert texts(sinks.FAILED) == sorted(r.value for r in json_results(whole.filter("error IS NOT NULL")).collect())
    assert texts(sinks.COMPLETED) == sorted(f"u{i}.com" for i in range(12) if i % 3)
    assert sinks.committed_statistics(spark, folder).first().asDict() == run_statistics(whole).first().asDict()
    # A batch that is written but not committed is not read.
    sinks.write_batch(whole, 99, folder)
    assert sinks.read_committed(spark, folder, sinks.COMPLETED).count() == 16
    import shutil

    shutil.rmtree(f"{folder}/{sinks.COMMITS}/batch_id=99")
    assert texts(sinks.COMPLETED) == sorted(f"u{i}.com" for i in range(12) if i % 3)


def test_wired_streams_read_tables_of_many_files(spark, tmp_path):
    """A table may be a folder; its files may be in any order of time, and no row of them is late."""
    from sitemarks.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    for table, key in (("pages", "page_id"), ("events", "event_id")):
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        for part in (2, 0, 1):
            rows.filter(F.col(key) % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("stream_outputs", "stream_detection", "stream_progress", "stream_retry_queue"):
        whole, parts = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
        assert whole and parts == whole, name


def test_nothing_committed_is_no_rows(spark, page_table, tmp_path):
    """A run over a source without files commits nothing; its readers say so, with the counters of no results."""
    (tmp_path / "archive").mkdir()
    stream = stream_detect(stream_pages(spark, str(tmp_path / "archive")))
    sinks.run_to_sinks(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    for output, schema in ((sinks.RESULTS, stream.schema), (sinks.LINES, "value string")):
        assert sinks.read_committed(spark, str(tmp_path / "out"), output, schema).collect() == []
    whole = run_statistics(detect(page_table("")).limit(0).withColumn("error", F.lit(None).cast("string")))
    assert sinks.committed_statistics(spark, str(tmp_path / "out")).first().asDict() == whole.first().asDict()


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map(dict):
    calls = 0

    def getValue(self, place):
        self.calls += 1
        return self[place]

    def updateValue(self, place, value):
        self.calls += 1
        self[place] = value

    def removeKey(self, place):
        self.calls += 1
        del self[place]

    def keys(self):
        self.calls += 1 + len(self)
        return iter(list(super().keys()))


class _Handle:
    """State of one key and its timers, as a processor sees them."""

    def __init__(self):
        self.map, self.timers, self.registered = _Map(), set(), 0

    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, key, value):
        return self.map

    def registerTimer(self, at):
        self.timers.add(at)
        self.registered += 1


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _watched(batches):
    """The alerts of one key's micro-batches of frames, each followed by the watermark given with it."""
    watch, handle, found = blocking.BlockWatch(5, 20, 0.6, 50, 5, 60), _Handle(), []
    watch.init(handle)
    for frames, watermark in batches:
        list(watch.handleInputRows(("r", "1"), iter(frames), None))
        for at in sorted(t for t in handle.timers if t <= watermark):
            found += list(watch.handleExpiredTimer(("r", "1"), _Watermark(watermark), _Watermark(at)))
            handle.timers.remove(at)
    assert not handle.map or min(handle.timers) <= (min(us for c in handle.map.values() for us in c[0]) // 60_000_000 + 1) * 60_000
    return pd.concat(found, ignore_index=True), handle


def _attempts(n, seconds):
    """Attempts at random times, some dense hours among sparse days, in no order; ids beyond what a double holds."""
    rng = random.Random(n)
    times = sorted(rng.randrange(seconds) if i % 2 else 7200 + rng.randrange(5400) for i in range(n))
    rows = pd.DataFrame({
        "us": [1_704_067_200_000_000 + t * 1_000_000 for t in times],
        "attempt_id": [2**60 + i for i in range(n)],
        "is_blocking": [rng.random() < 0.85 for _ in range(n)],
        "domain": [rng.choice(["a", "b", "c", None]) for _ in range(n)],
        "ends": [False] * n,
    })
    rows["domain"] = rows["domain"].astype(object).where(rows["domain"].notna(), None)
    whole, _ = alert_rows(rows.rename(columns={"us": "ts"}), 0, 0, 0, 5, 20, 0.6)
    return rows, whole


def _same(got, whole):
    columns = list(whole.columns)
    return got[columns].astype(str).values.tolist() == whole.astype(str).values.tolist() and len(whole) > 20


def test_work_on_waiting_rows_grows_with_them_not_with_their_square():
    for n in (2_000, 8_000):
        rows, whole = _attempts(n, 30 * 86_400)
        shuffled = rows.sample(frac=1, random_state=1)
        got, handle = _watched([([shuffled[i : i + 1000] for i in range(0, n, 1000)], 0), ([], 4_000_000_000_000)])
        assert _same(got, whole) and not handle.map
        # An entry is written, listed, read and removed; a bucket of its own for each row would make 4 n and, listed for each timer, n * n.
        assert handle.map.calls < n + 4 * 720 + 1 and handle.registered <= 1


def test_watermarks_within_slots_let_go_of_whole_buckets(monkeypatch):
    """Batches of rows up to two hours out of order; sparse and dense entries of one slot, few rows held at a time."""
    monkeypatch.setattr(blocking, "HELD_ROWS", 150)
    rows, whole = _attempts(6_000, 86_400)
    rng = random.Random(9)
    late = rows.iloc[sorted(range(len(rows)), key=lambda i: rows["us"].iloc[i] + rng.uniform(0, 7_200e6))]
    batches, top = [], 0
    for i in range(0, len(late), 400):
        part = late[i : i + 400]
        top = max(top, int(part["us"].max()))
        batches.append(([part[:130], part[130:]], top // 1000 - 7_200_000))
    got, handle = _watched([*batches, ([], 4_000_000_000_000)])
    assert _same(got, whole) and not handle.map
