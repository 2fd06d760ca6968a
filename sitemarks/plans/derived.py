"""Derived views over the supplied tables: the inputs of the wired-up queries.

The supplied pages hold no vendor markup, so every page gets one of 16 snippets
by its id. The literals below are shared with the SQL side; the logic is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.functions.urls import normalize_url
from sitemarks.session import spread

_GUID = "7be4a1c0-92d3-4f58-8a61-0c9d35e7f214"
_FORMS_JS = '<script src="//js.hsforms.net/forms/v2.js"></script>'

#: Snippet put before ``</head>``, by ``page_id % 16``.
SNIPPETS = [
    "",
    '<script defer id="hs-script-loader" src="//js.hs-scripts.com/906713.js" async></script>',
    '<script src="//js.hs-scripts.com/730118.js"></script>',
    '<script src="//js.hs-analytics.net/analytics/7003115/480092.js"></script>',
    '<meta name="generator" content="HubSpot">',
    '<link rel="stylesheet" href="/_hcms/style.css"><div class="hs_cos_wrapper"></div>',
    '<div class="hs_cos_wrapper"></div>',
    _FORMS_JS + f'<script>hbspt.forms.create({{portalId: "906713", formId: "{_GUID}"}});</script>',
    _FORMS_JS,
    f"<script src=\"https://js.hscta.net/cta/current.js\"></script><script>hbspt.cta.load(906713, '{_GUID}');</script>",
    '<iframe src="https://play.hubspotvideo.com/906713"></iframe>',
    '<script src="//js.usemessages.com/conversations-embed.js"></script>',
    '<script src="https://js.hs-banner.com/906713.js"></script>'
    "<script>window._hsq = window._hsq || []; _hsq.push([1]);</script>",
    '<link rel="canonical" href="https://example.com/page?_hsmi=906713&_hsenc=p2A">',
    '<link rel="stylesheet" href="https://906713.fs1.hubspotusercontent-na1.net/style.css">',
    '<script id="hs-script-loader" src="//js.hs-scripts.com/111.js"></script>'
    '<script src="//js.hs-analytics.net/analytics/9/222.js"></script>'
    '<script>var c="messagesUtk hubspotutk";</script>',
]

#: Network request of a page, by ``page_id % 11``.
NETWORK_URLS = [
    "https://track.hubspot.com/__ptq.gif?x=1",
    f"https://forms.hubspot.com/uploads/form/v2/1/{_GUID}",
    f"https://api.hsforms.com/submissions/v3/integration/submit/1/{_GUID}",
    "https://meetings.hubspot.com/a/b?embed=true",
    "https://x.hs-sales-engage.com/a",
    "https://t.hubspotlinks.com/x",
    "https://api.usemessages.com/v1",
    "https://example.com/script.js",
    "https://js.hs-scripts.com/906713.js",
    "https://a.hs-sites.com/x",
    "https://c.hubspotemail.net/x",
]

#: Response header of a page, by ``page_id % 5``: name and value.
COOKIE_HEADERS = [
    None,
    ("set-cookie", "hubspotutk=a; Path=/"),
    ("set-cookie", "__hstc=x; Path=/"),
    ("set-cookie", "hubspotutk=a; Path=/, __hstc=x; Path=/"),
    ("Set-Cookie", "messagesUtk=m"),
]

#: Attempt outcome by event type: success, status code, error text.
ATTEMPT_OUTCOMES = {
    "error": (False, 403, None),
    "click": (False, None, "Connection reset by peer"),
    "view": (False, 429, None),
    "signup": (False, 404, None),
    "purchase": (True, 200, None),
}

#: Error text of a fetch by event type, for the retry decisions.
FETCH_ERRORS = {
    "error": "HTTP error: 403 Forbidden",
    "click": "Connection reset by peer",
    "view": "Too Many Requests",
    "signup": "certificate has expired",
    "purchase": None,
}

LITERAL_INPUTS = ["https://example.com", "example.org"]
RUN_ID = "r1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def derive_sites(pages: DataFrame) -> DataFrame:
    """The page archive view of a ``pages`` table (batch or stream)."""
    pid = F.col("page_id")
    original = F.when(pid % 4 == 0, F.regexp_replace("url", "^https://", "")).otherwise(F.col("url"))
    headers = F.create_map().cast("map<string,string>")
    for n, header in enumerate(COOKIE_HEADERS):
        if header:
            headers = F.when(pid % 5 == n, F.create_map(*map(F.lit, header))).otherwise(headers)
    df = pages.select("page_id", original.alias("original_url"), "html")
    requested = normalize_url("original_url")
    return df.select(
        "page_id",
        "original_url",
        requested.alias("requested_url"),
        requested.alias("final_url"),
        F.when(pid % 10 == 9, 404).otherwise(200).alias("http_status"),
        headers.alias("headers"),
        F.replace("html", F.lit("</head>"), F.concat(pick(SNIPPETS, pid % 16), F.lit("</head>"))).alias("html"),
        F.timestamp_micros((F.lit(1704067200) + pid) * 1000000).alias("fetched_at"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_sites(spread(table(spark, sf_dir, "pages"), "page_id"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.lit(0).alias("pos"), pick(NETWORK_URLS, F.col("page_id") % 11).alias("url"))


def derive_attempts(events: DataFrame) -> DataFrame:
    """The attempt log view of an ``events`` table (batch or stream)."""
    kind = F.col("event_type")
    success, status, error = F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (ok, code, text) in ATTEMPT_OUTCOMES.items():
        success = F.when(kind == name, F.lit(ok)).otherwise(success)
        status = F.when(kind == name, F.lit(code).cast("int")).otherwise(status)
        error = F.when(kind == name, F.lit(text).cast("string")).otherwise(error)
    host = F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".example.com/p"))
    original = F.concat(host, (F.col("event_id") % 13).cast("string"))
    return events.select(
        F.lit(RUN_ID).alias("run_id"),
        (F.col("user_id") % 8).cast("string").alias("egress"),
        F.col("event_id").alias("attempt_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://"), original).alias("url"),
        original.alias("original_url"),
        (F.col("event_id") % 4).cast("int").alias("variation_no"),
        (F.col("event_id") % 3).cast("int").alias("retry_no"),
        success.alias("success"),
        status.alias("status_code"),
        error.alias("error"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_attempts(table(spark, sf_dir, "events"))


def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose error text is what a failed fetch reports, its URL included."""
    events = table(spark, sf_dir, "events")
    text = F.lit(None).cast("string")
    for name, message in FETCH_ERRORS.items():
        if message:
            text = F.when(F.col("event_type") == name, F.lit(message)).otherwise(text)
    url = F.concat(F.lit("https://d"), F.col("user_id").cast("string"), F.lit(".example.com/p"))
    return events.select(
        F.col("event_id").alias("attempt_id"),
        url.alias("url"),
        (F.col("event_id") % 3).cast("int").alias("retry_no"),
        text.isNull().alias("success"),
        F.concat(F.lit("Failed to fetch "), url, F.lit(": "), text).alias("error"),
    )


#: Gap between the blocks of derived input lines.
INPUT_STEP = 1 << 40


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw input lines ``input_pos, line``: all URLs, then repeats, comments, padded, blank and bare ones."""
    pages = table(spark, sf_dir, "pages")
    blocks = [
        (1, F.lit(True), F.col("url")),
        (7, None, F.col("url")),
        (11, None, F.concat(F.lit("# "), F.col("url"))),
        (13, None, F.concat(F.lit("  "), F.col("url"), F.lit(" "))),
        (17, None, F.lit("")),
        (5, None, F.regexp_replace("url", "^https?://", "")),
    ]
    entries = F.array(
        *[
            F.when(F.col("page_id") % step == 0, F.struct(F.lit(i * INPUT_STEP).alias("base"), line.alias("line")))
            for i, (step, _, line) in enumerate(blocks)
        ]
    )
    return pages.select("page_id", F.explode(F.array_compact(entries)).alias("x")).select(
        (F.col("x.base") + F.col("page_id")).alias("input_pos"), F.col("x.line").alias("line")
    )


def completed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of completed URLs, some of them logged twice."""
    pages = table(spark, sf_dir, "pages").filter("page_id % 3 = 0")
    times = F.when(F.col("page_id") % 15 == 0, 2).otherwise(1)
    return pages.select(F.explode(F.array_repeat("url", times)).alias("original_url"))


def failed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("page_id % 7 = 1").select(F.col("url").alias("original_url"))
