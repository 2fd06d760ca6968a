"""Result rows, metadata, flat and JSON shapes, sinks, validation, run analytics."""

import csv
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitemarks.functions.durations import clock_time, spoken_time, utc_text
from sitemarks.functions.html import page_description, page_resources, page_title
from sitemarks.operators import results as r
from sitemarks.operators import runs
from sitemarks.operators.validation import json_violations, result_violations
from sitemarks.sources import network_log, pages, sinks
from sitemarks.sources.catalog import load_catalog

LOADER = '<script id="hs-script-loader" src="//js.hs-scripts.com/906713.js"></script>'
EVIDENCE = (
    "page_id long, evidence array<struct<category:string,pattern_id:string,match:string,source:string,hub_id:bigint,"
    "confidence:string,context:string>>"
)
ATTEMPTS = (
    "run_id string, egress string, attempt_id long, ts timestamp, url string, original_url string, variation_no int, "
    "retry_no int, success boolean, status_code int, error string"
)


def evidence(category, pattern="p", match="m", level="strong", hub_id=None):
    return (category, pattern, match, "html", hub_id, level, None)


@pytest.mark.parametrize(
    "items, raised, level, detected",
    [
        ([], [], "weak", False),
        ([evidence("tracking", "tracking_loader_script", level="definitive", hub_id=1)], ["tracking"], "definitive", True),
        ([evidence("tracking", "tracking_loader_script", level="strong")], ["tracking"], "strong", True),
        ([evidence("cookies", "tracking_loader_script", "HubSpotUtk", "definitive")], ["tracking"], "definitive", True),
        ([evidence("cookies", "cookie_any", "__hstc")], [], "moderate", False),
        ([evidence("cookies", "cookie_any", "__hstc", "moderate")], [], "weak", False),
        ([evidence("cms")], ["cms_hosting"], "moderate", True),
        ([evidence("cms", level="moderate")], [], "weak", False),
        ([evidence("files", level="moderate")], [], "weak", False),
        ([evidence("email", level="moderate")], ["email_tracking"], "weak", True),
        ([evidence(c) for c in ("forms", "chat", "ctas", "meetings", "video")], ["forms", "chat", "ctas_legacy", "meetings", "video"], "moderate", True),
    ],
)
def test_summary(spark, items, raised, level, detected):
    df = spark.createDataFrame([(1, items)], EVIDENCE)
    row = r.with_summary(df).first()
    assert [f for f in r.FLAGS if row[f]] == raised
    assert (row.confidence, row.hubspot_detected) == (level, detected)
    rows = df.select("page_id", F.posexplode("evidence").alias("seq", "e")).select("page_id", "seq", "e.*")
    long = r.summarise_rows(df, rows).first()
    assert [f for f in r.FLAGS if long[f]] == raised
    assert (long.confidence, long.hubspot_detected, long.evidence_count) == (level, detected, len(items))


def test_account_ids_are_distinct_in_first_seen_order(spark):
    items = [evidence("tracking", hub_id=i) for i in (7, None, 3, 7, 9, 3)]
    df = spark.createDataFrame([(1, items)], EVIDENCE)
    assert r.with_summary(df).first().hub_ids == [7, 3, 9]
    rows = df.select("page_id", F.posexplode("evidence").alias("seq", "e")).select("page_id", "seq", "e.*")
    assert r.hub_ids_by_page(rows).first().hub_ids == [7, 3, 9]


@pytest.mark.parametrize(
    "html, title, description",
    [
        ("<title>T</title><meta name='description' content='D'>", "T", "D"),
        ("<html><head></head></html>", None, None),
        ("<title></title><meta name=description content=''>", None, None),
        ("<title> \n  </title>", None, None),
        ("<title>Unclosed tag", "Unclosed tag", None),
        ("<meta name='Description' content='x'>", None, None),
        ("<meta name='description' content='  x &amp; y  '><meta name='description' content='z'>", None, "x & y"),
        ("<title>\n Multi\n Line </title>", "Multi\n Line", None),
        ("<!-- <title>no</title> --><script>'<title>no</title>'</script><TITLE a='>'>yes</TITLE>", "yes", None),
        ("<title>&#233;&#xE9;&eacute;&unknown;&#0;</title>", "ééé&unknown;�", None),
        ("<title>Bob&apos;s A&#0000000065;&#x0000000041;&#99999999999999;</title>", "Bob's AAA\ufffd", None),
        ("<meta content='c' name=\"description\"/>", None, "c"),
        ("<meta property='description' content='c'>", None, None),
        (None, None, None),
    ],
)
def test_metadata(spark, html, title, description):
    df = spark.createDataFrame([(html,)], "html string").withColumn("html", F.coalesce("html", F.lit("")))
    row = df.select(page_title("html").alias("t"), page_description("html").alias("d")).first()
    assert (row.t, row.d) == (title, description)


def test_resources_in_document_order(spark):
    html = (
        "<!-- <script src=no.js> --><script data-src=x SRC='a.js?x=1&amp;y=2'>var s = '<link href=no.css>';</script>"
        "<link rel=a href=/b.css><iframe src=//v.com/1></iframe><link href=''><a href=c>c</a><script src=\"a.js?x=1&amp;y=2\"></script>"
        "<style><iframe src=no></style><linker href=no><link title='x > y' href=\"d e\">"
    )
    df = spark.createDataFrame([(html,)], "html string")
    base = "'https://e.com/d/p'"
    assert df.select(page_resources("html", base)).first()[0] == [
        "https://e.com/d/a.js?x=1&y=2", "https://e.com/b.css", "https://v.com/1", "https://e.com/d/d e",
    ]
    assert df.select(page_resources("html", base, {"a": "href"})).first()[0] == ["https://e.com/d/c"]


def test_huge_and_hostile_pages(spark):
    texts = ["<" * 300_000, "<script " + "a='b' " * 100_000, "<!--" * 100_000, "<title" + " x='" * 50_000, "&" * 100_000 + "<title>ok"]
    df = spark.createDataFrame([(t,) for t in texts], "html string")
    rows = df.select(page_title("html").alias("t"), page_resources("html", "'https://e.com'").alias("r")).collect()
    assert [x.t for x in rows] == [None, None, None, None, "ok"] and all(x.r == [] for x in rows)


def test_error_pages_are_analysed_but_keep_their_original_url(page_table):
    rows = r.detect(
        page_table(
            {"html": LOADER, "status": 404, "original_url": "e.com", "url": "https://e.com"},
            {"html": LOADER, "status": 200, "original_url": "e.com", "url": "https://e.com"},
            {"html": "", "status": None, "original_url": "e.com", "url": "https://e.com"},
        )
    ).orderBy("page_id").collect()
    assert [x.final_url for x in rows] == ["e.com", "https://e.com", "https://e.com"]
    assert [x.hub_ids for x in rows] == [[906713], [906713], []]


def test_a_page_with_nothing_known_still_has_a_result(spark, page_table):
    known = page_table(LOADER)
    row = r.detect(known.selectExpr("page_id", *[f"cast(NULL AS {t}) AS {c}" for c, t in known.dtypes[1:]])).first()
    assert (row.evidence, row.hub_ids, row.confidence, row.headers, row.hubspot_detected) == ([], [], "weak", {}, False)
    bare = known.withColumn("requested_url", F.lit(None).cast("string")).withColumn("headers", F.lit(None).cast("map<string,string>"))
    assert r.detect(bare).first().hub_ids == [906713]


def test_time_text_is_utc_in_any_session(spark, page_table):
    results = r.detect(page_table("")).select("original_url", F.timestamp_micros(F.lit(1714557600000001)).alias("t"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert results.select(utc_text(F.col("t"))).first()[0] == "2024-05-01T10:00:00.000001Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def failed(spark):
    rows = [
        ("r", "1", 1, datetime(2024, 5, 1), "https://bad.com", "bad.com", 0, 0, False, 403, None),
        ("r", "1", 2, datetime(2024, 5, 2), "https://www.bad.com", "bad.com", 1, 0, False, None, "x"),
        ("r", "1", 3, datetime(2024, 5, 2), "https://good.com", "good.com", 0, 0, False, None, "x"),
        ("r", "1", 4, datetime(2024, 5, 3), "https://www.good.com", "good.com", 1, 1, True, 200, None),
        ("r", "1", 5, datetime(2024, 5, 3), "https://www.good.com/", "good.com", 2, 0, True, 200, None),
    ]
    return spark.createDataFrame(rows, ATTEMPTS)


def test_failures_have_the_shape_of_successes(spark, page_table):
    bad = r.failure_results(failed(spark), max_retries=2)
    good = r.detect(page_table(LOADER))
    assert bad.dtypes == good.dtypes
    row = bad.first()
    assert bad.count() == 1
    assert (row.original_url, row.final_url, row.confidence, row.evidence, row.attempts) == ("bad.com", "bad.com", "weak", [], 2)
    assert row.error == "Failed after all retry attempts and 3 URL variations"
    assert row.attempted_urls == ["https://bad.com", "https://www.bad.com", "http://bad.com", "https://bad.com/"]
    plain = r.failure_results(failed(spark), try_variations=False).first()
    assert (plain.error, plain.attempted_urls) == ("Failed after all retry attempts", ["https://bad.com"])
    flat = r.flat_results(good.unionByName(bad))
    assert tuple(flat.columns) == r.FLAT_COLUMNS and len(flat.columns) == 19
    row = flat.filter("original_url = 'bad.com'").first()
    assert (row.hub_ids, row.hub_id_count, row.evidence_count, row.http_status, row.page_title) == ("", 0, 0, "", "")


def test_resolved_urls(spark):
    inputs = spark.createDataFrame([("bad.com",), ("good.com",)], "original_url string")
    rows = {x.original_url: x for x in runs.resolved_urls(inputs, failed(spark)).collect()}
    assert rows["bad.com"].working_url is None and rows["bad.com"].variation_type is None
    assert (rows["good.com"].working_url, rows["good.com"].variation_type) == ("https://www.good.com", "auto")


def test_sinks(spark, page_table, tmp_path):
    title = '<title>Say "hi", ü</title>'
    every = r.detect(page_table(LOADER + title, {"html": "", "status": None})).unionByName(r.failure_results(failed(spark)))
    for _ in range(2):  # sinks append
        sinks.write_results_jsonl(every, str(tmp_path / "json"))
    lines = [json.loads(line) for p in (tmp_path / "json").glob("part-*") for line in p.read_text().splitlines()]
    assert len(lines) == 6
    by_kind = {("error" in x, "http_status" in x): x for x in lines}
    good = by_kind[False, True]
    assert list(good) == ["original_url", "final_url", "timestamp", "hubspot_detected", "hubIds", "summary", "evidence",
                          "headers", "http_status", "page_metadata"]
    assert good["timestamp"] == "2024-05-01T10:00:00Z"
    assert good["page_metadata"] == {"title": 'Say "hi", ü', "description": None}
    assert good["evidence"][0] == {
        "category": "tracking", "patternId": "tracking_loader_script", "match": LOADER.removesuffix("</script>"),
        "source": "html", "hubId": 906713, "confidence": "definitive", "context": None,
    }
    assert good["summary"]["features"] == dict.fromkeys(
        ["forms", "chat", "ctasLegacy", "meetings", "video", "emailTrackingIndicators"], False
    )
    assert (False, False) in by_kind and "page_metadata" not in by_kind[True, False]

    sinks.write_results_csv(every.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    table = list(csv.DictReader(part.open(newline="", encoding="utf-8")))
    assert tuple(table[0]) == r.FLAT_COLUMNS
    assert {x["page_title"] for x in table} == {'Say "hi", ü', ""} and "" in {x["http_status"] for x in table}

    sinks.write_failures(every, str(tmp_path / "failed"))
    assert [x.original_url for x in spark.read.json(str(tmp_path / "failed")).collect()] == ["bad.com"]
    sinks.write_completed(every, str(tmp_path / "done"))
    assert spark.read.text(str(tmp_path / "done")).count() == 2
    pretty = r.json_results(every, pretty=True).first().value
    assert "\n" in pretty and json.loads(pretty)


def test_json_round_trip(page_table):
    results = r.detect(page_table(LOADER, "")).drop("page_id")
    back = r.parse_results(r.json_results(results))
    assert sorted(map(str, back.collect())) == sorted(map(str, results.select(*back.columns).collect()))


def test_url_variation_round_trip(spark, page_table):
    results = r.detect(page_table({"original_url": "a.com", "html": LOADER}, {"original_url": "b.com"}, {"original_url": "c.com", "status": None}))
    rows = [("a.com", 0, 0, 1, "https://a.com", False), ("a.com", 1, 0, 2, "http://a.com", True), ("b.com", 0, 0, 3, "https://b.com", True), ("c.com", 1, 0, 4, "http://c.com", True)]
    attempts = spark.createDataFrame(rows, "original_url string, variation_no int, retry_no int, attempt_id bigint, url string, success boolean")
    varied = r.with_url_variation(results, runs.resolved_urls(results, attempts)).drop("page_id")
    lines = r.json_results(varied)
    assert json_violations(lines).count() == 0
    back = {x.original_url: x.url_variation for x in r.parse_results(lines, url_variation=True).collect()}
    assert back["b.com"] is None
    assert tuple(back["a.com"]) == ("a.com", "http://a.com", "auto") and tuple(back["c.com"]) == ("c.com", "http://c.com", "auto")
    assert "url_variation" not in json.loads(lines.filter("original_url = 'b.com'").first().value)


def test_archive_and_network_sources(spark, page_table, tmp_path):
    page_table(LOADER).write.parquet(str(tmp_path / "archive"))
    assert r.detect(pages.read_pages(spark, str(tmp_path / "archive"))).first().confidence == "definitive"
    (tmp_path / "log.json").write_text(
        '{"url": "https://a.com", "status": null, "setCookies": ["a=1", "b=2"]}\n{"url": "https://b.com", "method": "GET", "status": 200}\n'
    )
    log = network_log.flatten_cookies(network_log.read_network_log(spark, str(tmp_path / "log.json")))
    rows = sorted((x.url, x.cookie_no or 0, x.cookie or "") for x in log.collect())
    assert rows == [("https://a.com", 1, "a=1"), ("https://a.com", 2, "b=2"), ("https://b.com", 0, "")]


def test_violations(spark, page_table):
    results = r.detect(page_table(LOADER, ""))
    assert result_violations(results).count() == 0
    broken = results.withColumns(
        {
            "confidence": F.when(F.col("page_id") == 1, "sure").otherwise(F.col("confidence")),
            "original_url": F.when(F.col("page_id") != 1, F.col("original_url")),
            "evidence": F.transform("evidence", lambda e: e.withField("match", F.lit(None).cast("string")).withField("source", F.lit("dom"))),
        }
    )
    rows = sorted((x.page_id, x.field, x.reason, x.evidence_no) for x in result_violations(broken).collect())
    assert rows == [
        (0, "evidence.match", "missing", 1), (0, "evidence.source", "not allowed", 1),
        (1, "confidence", "not allowed", None), (1, "original_url", "missing", None),
    ]


def test_json_violations(spark, page_table):
    good = r.json_results(r.detect(page_table(LOADER)).unionByName(r.failure_results(failed(spark))))
    assert json_violations(good).count() == 0
    text = json.loads(good.first().value)
    text.update(hubIds="x", evidence={}, final_url=3)
    del text["summary"]["tracking"], text["timestamp"]
    bad = spark.createDataFrame([("a", json.dumps(text)), ("b", "{nope")], "original_url string, value string")
    assert sorted((x.original_url, x.field, x.reason) for x in json_violations(bad).collect()) == [
        ("a", "evidence", "wrong type"), ("a", "final_url", "wrong type"), ("a", "hubIds", "wrong type"),
        ("a", "summary.tracking", "missing"), ("a", "timestamp", "missing"), ("b", "", "not JSON"),
    ]


def test_durations(spark):
    seconds = [0, 45, 125.9, 3599, 3665, 90061]
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(seconds)], "i int, s double").orderBy("i")
    rows = df.select(clock_time(F.col("s")).alias("c"), spoken_time(F.col("s")).alias("p")).collect()
    assert [x.c for x in rows] == ["0:00", "0:45", "2:05", "59:59", "1:01:05", "25:01:01"]
    assert [x.p for x in rows] == ["0s", "45s", "2m 5s", "59m 59s", "1h 1m", "25h 1m"]


def test_statistics_and_status(spark, page_table):
    every = r.detect(page_table(LOADER, LOADER, "", '<meta name="generator" content="HubSpot">')).unionByName(
        r.failure_results(failed(spark))
    )
    stats = runs.run_statistics(every, total_urls=10, elapsed_seconds=2.5)
    row = stats.first()
    assert (row.completed, row.success_count, row.failure_count, row.found_count) == (5, 4, 1, 3)
    assert (row.tracking_count, row.cms_count, row.definitive_count, row.moderate_count, row.weak_count) == (2, 1, 2, 1, 1)
    assert (row.unique_hub_ids, row.rate, row.eta_seconds, row.percentage) == (1, 2.0, 2.5, 50.0)
    text = runs.status_lines(stats).first()
    assert text.compact == (
        "Progress: 5/10 (50.0%) | Success: 4 | Failed: 1 | Rate: 2.0 URL/s | Elapsed: 0:02 | ETA: 0:02\n"
        "HubSpot Found: 3/4 (75.0%) | Hub IDs: 1 unique"
    )
    assert json.loads(text.json)["hubspot_detection"]["unique_hub_ids"] == 1
    none = runs.status_lines(runs.run_statistics(every.filter("error IS NOT NULL"), 1, 0)).first()
    assert "\n" not in none.compact and "ETA: 0:00" in none.compact
    empty = runs.run_statistics(every.limit(0)).first()
    assert (empty.completed, empty.rate, empty.percentage, empty.unique_hub_ids) == (0, 0.0, 0.0, 0)
    assert runs.distinct_hub_ids(every).first()[0] == runs.distinct_hub_ids(every, True).first()[0] == 1


def test_stalls_with_a_current_time(spark):
    times = ["10:00:00", "10:05:00", "10:15:00", "10:25:01", "10:25:02"]
    df = spark.createDataFrame([("r", f"2024-05-01 {t}") for t in times], "run_id string, t string").selectExpr(
        "run_id", "cast(t AS timestamp) AS ts"
    )
    assert [x.stall_seconds for x in runs.stall_gaps(df).collect()] == [601.0]
    now = runs.stall_gaps(df, now="2024-05-01 11:25:02").collect()
    assert sorted(x.stall_seconds for x in now) == [601.0, 3600.0]


@pytest.mark.parametrize(
    "error, retry_no, decision, wait",
    [
        ("429", 0, "rate_limited", 120), ("Too Many Requests", 2, "rate_limited", 120), ("x 403 y", 0, "forbidden", 0),
        ("Forbidden", 0, "forbidden", 0), ("dns", 0, "retry", 5), ("HTTP 500", 1, "retry", 15), ("network", 2, "give_up", 0),
        ("", 0, "give_up", 0), (None, 0, "give_up", 0), ("Failed to fetch https://e5.com", 0, "retry", 5),
    ],
)
def test_retry_plan(spark, error, retry_no, decision, wait):
    df = spark.createDataFrame([(error, retry_no, False)], "error string, retry_no int, success boolean")
    row = runs.retry_plan(df).first()
    assert (row.decision, row.wait_seconds) == (decision, wait)


def test_catalogue_profile_counts_unmatched_patterns(page_table):
    from sitemarks.operators.evidence import catalog_profile

    rows = {x.pattern_id: x.n_pages for x in catalog_profile(page_table(LOADER, LOADER, ""), load_catalog()).collect()}
    assert len(rows) == 31 and rows["tracking_loader_script"] == 2 and rows["video_hubspotvideo"] == 0


def test_links_that_cannot_be_resolved_are_left_out(page_table):
    html = "".join(f'<script src="{u}"></script>' for u in ("//[bad/x.js", "http://[::1/x.js", "http://[::1]/y.js", "z.js"))
    got = page_table(html).select(page_resources("html", "'https://e.com/'")).first()[0]
    assert got == ["http://[::1]/y.js", "https://e.com/z.js"]
