"""One query per operator over the supplied tables; each takes ``(spark, sf_dir)``.

Arrays and times leave as text so that results compare across engines.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.functions.html import page_description, page_resources, page_title
from sitemarks.functions.urls import normalize_url, url_domain
from sitemarks.operators import blocking, evidence, results, runs, signature_index, url_prep, validation
from sitemarks.plans import derived
from sitemarks.session import scratch_path
from sitemarks.sources import network_log
from sitemarks.sources.catalog import catalog_frame, load_catalog
from sitemarks.streaming import blocking as stream_blocking
from sitemarks.streaming import detection as stream_detection
from sitemarks.streaming import inputs as stream_inputs
from sitemarks.streaming import progress as stream_progress
from sitemarks.streaming import sinks as stream_sinks

MAX_PER_DOMAIN = 2
SNAPSHOT_EVERY = 100
MAX_RETRIES = 3
#: Page elements whose links the resource query follows: the defaults and anchors.
LINK_TAGS = {"script": "src", "link": "href", "iframe": "src", "a": "href"}


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _joined(array: str | Column) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(array.cast("array<string>"), ",")


# --- inputs ---------------------------------------------------------------------------------------


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return url_prep.clean_lines(derived.url_lines(spark, sf))


def url_list_clean(spark, sf):
    return _inputs(spark, sf)


def url_inputs_union(spark, sf):
    return url_prep.union_inputs(_inputs(spark, sf), derived.LITERAL_INPUTS)


def url_dedup(spark, sf):
    return url_prep.dedup_urls(_inputs(spark, sf))


def resume_pending(spark, sf):
    return url_prep.pending_urls(_inputs(spark, sf), derived.completed_log(spark, sf))


def run_reconcile(spark, sf):
    return runs.run_reconcile(_inputs(spark, sf), derived.completed_log(spark, sf), derived.failed_log(spark, sf))


def url_normalized(spark, sf):
    return _inputs(spark, sf).select("input_pos", "original_url", normalize_url("original_url").alias("url"))


def url_domain_query(spark, sf):
    return url_normalized(spark, sf).select("input_pos", "url", url_domain("url").alias("domain"))


def url_variations_query(spark, sf):
    df = url_prep.variations(url_normalized(spark, sf))
    return df.select("input_pos", "url", "variation_no", "variation_url")


def domain_waves(spark, sf):
    df = url_prep.domain_waves(url_normalized(spark, sf), MAX_PER_DOMAIN)
    return df.select("input_pos", "url", "domain", "wave")


# --- pages ----------------------------------------------------------------------------------------


def page_resources_query(spark, sf):
    urls = page_resources("html", "requested_url", LINK_TAGS)
    df = derived.sites(spark, sf).select("page_id", F.posexplode(urls).alias("pos", "url"))
    return df.select("page_id", (F.col("pos") + 1).alias("pos"), "url")


def page_metadata(spark, sf):
    return derived.sites(spark, sf).select(
        "page_id", page_title("html").alias("title"), page_description("html").alias("description")
    )


def final_url_rule(spark, sf):
    rule = results.final_url_rule(F.col("original_url"), F.col("final_url"), F.col("http_status"))
    return derived.sites(spark, sf).select("page_id", "original_url", "http_status", rule.alias("final_url"))


def network_log_flat(spark, sf):
    """Captured requests as JSON text (built from the network view), parsed and flattened per cookie."""
    cookies = F.array_repeat(F.lit("hubspotutk=a; Path=/"), (F.col("page_id") % 3).cast("int"))
    event = F.struct(
        F.col("url"),
        F.lit("GET").alias("method"),
        F.when(F.col("page_id") % 4 > 0, 200).alias("status"),
        cookies.alias("setCookies"),
    )
    lines = derived.network(spark, sf).select("page_id", F.to_json(event).alias("value"))
    return network_log.flatten_cookies(network_log.parse_network_log(lines))


# --- evidence -------------------------------------------------------------------------------------


def html_evidence(spark, sf):
    return evidence.html_evidence(derived.sites(spark, sf)).drop("context")


def network_evidence(spark, sf):
    return evidence.network_evidence(derived.network(spark, sf)).drop("context")


def cookie_evidence(spark, sf):
    return evidence.cookie_evidence(derived.sites(spark, sf)).drop("context")


def _evidence_rows(spark, sf):
    return evidence.evidence_rows(derived.sites(spark, sf), derived.network(spark, sf))


def evidence_all(spark, sf):
    return _evidence_rows(spark, sf).drop("context", "seq")


def catalog_theta_join(spark, sf):
    return evidence.catalog_matches(derived.sites(spark, sf), load_catalog())


def catalog_index_join(spark, sf):
    """The built-in patterns and one for every host label of the archive, through the inverted index."""
    sites = derived.sites(spark, sf)
    label = F.regexp_extract("url", "://([a-z]+)[.]", 1)
    own = derived.table(spark, sf, "pages").select(label.alias("label")).filter("label <> ''").distinct()
    regex = F.concat(F.lit("[ >]"), F.col("label"), F.lit("[a-z]{2}[ <]"))
    own = own.select(F.concat(F.lit("label_"), F.col("label")).alias("pattern_id"), regex.alias("regex"))
    known = catalog_frame(spark, load_catalog()).select("pattern_id", "regex")
    return signature_index.indexed_matches(sites, known.unionByName(own))


def catalog_profile(spark, sf):
    return evidence.catalog_profile(derived.sites(spark, sf), load_catalog())


def evidence_by_category(spark, sf):
    return runs.evidence_by_category(_evidence_rows(spark, sf))


def prefilter_parity(spark, sf):
    """Per page and form of the matcher: evidence found without and with the literal pre-filter."""
    df = evidence.with_html_evidence(derived.sites(spark, sf), out="plain", prefilter=False)
    df = evidence.with_html_evidence(df, out="guarded", prefilter=True)
    return df.select(
        "page_id",
        F.size("plain").alias("n_plain"),
        F.size("guarded").alias("n_guarded"),
        F.col("plain").eqNullSafe(F.col("guarded")).alias("same"),
    )


# --- results --------------------------------------------------------------------------------------


def _results(spark, sf):
    return results.detect(derived.sites(spark, sf))


def _all_results(spark, sf):
    """A run: detection results of the pages and failures of the attempt log."""
    return _results(spark, sf).unionByName(results.failure_results(derived.attempts(spark, sf), MAX_RETRIES))


def _result_text(df: DataFrame) -> DataFrame:
    item = lambda e: F.concat_ws(
        ":", e["category"], e["pattern_id"], e["source"], e["confidence"],
        F.coalesce(e["hub_id"].cast("string"), F.lit("-")), e["match"],
    )
    return df.select(
        "page_id", "original_url", "final_url", ts_text(F.col("fetched_at")).alias("fetched_at"), "http_status",
        "hubspot_detected", _joined("hub_ids").alias("hub_ids"), *results.FLAGS, "confidence",
        F.array_join(F.transform("evidence", item), " | ").alias("evidence"), "page_title", "page_description",
    )


def detection_result(spark, sf):
    return _result_text(_results(spark, sf))


def summary_flags(spark, sf):
    df = results.summarise_rows(derived.sites(spark, sf), _evidence_rows(spark, sf))
    return df.select("page_id", *results.FLAGS, "evidence_count")


def confidence_level(spark, sf):
    return results.summarise_rows(derived.sites(spark, sf), _evidence_rows(spark, sf)).select("page_id", "confidence")


def detected_flag(spark, sf):
    df = results.summarise_rows(derived.sites(spark, sf), _evidence_rows(spark, sf))
    return df.select("page_id", "hubspot_detected")


def hub_ids_by_page(spark, sf):
    df = results.hub_ids_by_page(_evidence_rows(spark, sf))
    return df.select("page_id", _joined("hub_ids").alias("hub_ids"))


def multi_portal_pages(spark, sf):
    df = results.multi_portal_pages(_results(spark, sf))
    return df.select("page_id", _joined("hub_ids").alias("hub_ids"))


def result_flat(spark, sf):
    return results.flat_results(_all_results(spark, sf))


def result_json(spark, sf):
    return results.json_results(_all_results(spark, sf))


def failure_results(spark, sf):
    df = results.failures(_all_results(spark, sf))
    return df.select(
        "original_url", "final_url", "hubspot_detected", "confidence", "error", "attempts",
        _joined("attempted_urls").alias("attempted_urls"), ts_text(F.col("fetched_at")).alias("fetched_at"),
    )


def completed_urls(spark, sf):
    return results.completed(_all_results(spark, sf))


def _tampered(df: DataFrame) -> DataFrame:
    """Results with planted faults, so that validation has something to find."""
    pid = F.col("page_id")
    swap = lambda e, i: F.when(
        (i == 0) & (pid % 7 == 2), e.withField("source", F.lit("dom"))
    ).when((i == 0) & (pid % 11 == 4), e.withField("category", F.lit(None).cast("string"))).otherwise(e)
    return df.withColumns(
        {
            "final_url": F.when(pid % 17 != 3, F.col("final_url")),
            "confidence": F.when(pid % 13 == 5, "certain").otherwise(F.col("confidence")),
            "evidence": F.transform("evidence", swap),
        }
    )


def result_violations(spark, sf):
    return validation.result_violations(_tampered(_results(spark, sf)))


#: Faults planted in exported JSON, by ``page_id``: modulus, remainder, text, and what replaces it.
JSON_FAULTS = [
    (7, 1, '"tracking":', '"tracked":'),
    (5, 2, '"hubIds":[', '"hubIds":["x"],"more":['),
    (9, 4, '"forms":', '"forms":0,"polls":'),
    (11, 6, '"patternId":', '"pattern":'),
    (8, 3, '"title":', '"title":["a"],"heading":'),
    (13, 5, '{"original_url"', '"original_url"'),
]


def json_violations(spark, sf):
    rows = _results(spark, sf)
    value = F.to_json(results.json_struct(), {"ignoreNullFields": "false"})
    for modulus, rest, old, new in JSON_FAULTS:
        value = F.when(F.col("page_id") % modulus == rest, F.replace(value, F.lit(old), F.lit(new))).otherwise(value)
    return validation.json_violations(rows.select("page_id", value.alias("value")), key="page_id", formats=True)


def result_url_variation(spark, sf):
    """Every third page's first URL failed; for half of these the plain-text variation worked."""
    sites = derived.sites(spark, sf)
    other = F.regexp_replace("requested_url", "^https:", "http:")
    tries = F.array(
        F.struct(F.col("requested_url").alias("url"), F.lit(0).alias("variation_no"), (F.col("page_id") % 3 != 0).alias("success")),
        F.struct(other.alias("url"), F.lit(1).alias("variation_no"), (F.col("page_id") % 6 == 0).alias("success")),
    )
    attempts = sites.select("original_url", F.lit(0).alias("retry_no"), F.col("page_id").alias("attempt_id"), F.explode(tries).alias("t"))
    resolved = runs.resolved_urls(sites, attempts.select("original_url", "retry_no", "attempt_id", "t.*"))
    lines = results.json_results(results.with_url_variation(_results(spark, sf), resolved))
    return lines.select("original_url", F.get_json_object("value", "$.url_variation").alias("url_variation"))


# --- runs -----------------------------------------------------------------------------------------


def run_statistics(spark, sf):
    return runs.run_statistics(_all_results(spark, sf))


def run_status_json(spark, sf):
    return runs.status_lines(runs.run_statistics(_all_results(spark, sf))).select("compact", "detailed", "json")


def confidence_distribution(spark, sf):
    return runs.confidence_distribution(_all_results(spark, sf))


def hub_id_usage(spark, sf):
    return runs.hub_id_usage(_all_results(spark, sf))


def progress_snapshots(spark, sf):
    run = _all_results(spark, sf).withColumn("run_id", F.lit(derived.RUN_ID))
    df = runs.progress_snapshots(run, SNAPSHOT_EVERY)
    return df.withColumn("fetched_at", ts_text(F.col("fetched_at")))


def progress_by_window(spark, sf):
    df = runs.progress_by_window(derived.attempts(spark, sf))
    return df.withColumn("window_start", ts_text(F.col("window_start")))


def _stall_text(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", ts_text(F.col("last_update")).alias("last_update"), ts_text(F.col("next_update")).alias("next_update"),
        "stall_seconds",
    )


def stall_gaps(spark, sf):
    return _stall_text(runs.stall_gaps(derived.attempts(spark, sf)))


def stall_open(spark, sf):
    """The stall that is still going on an hour after the last attempt of all."""
    attempts = derived.attempts(spark, sf)
    now = attempts.agg(F.max("ts") + F.expr("INTERVAL 1 HOUR")).first()[0]
    return _stall_text(runs.stall_gaps(attempts, now=str(now)).filter(F.col("next_update") == F.lit(str(now)).cast("timestamp")))



def retry_plan(spark, sf):
    return runs.retry_plan(derived.fetch_errors(spark, sf), MAX_RETRIES).select(
        "attempt_id", "retry_no", "decision", "wait_seconds", "last_status"
    )


def resolved_url(spark, sf):
    attempts = derived.attempts(spark, sf)
    inputs = attempts.select("original_url").distinct()
    return runs.resolved_urls(inputs, attempts)


# --- blocking -------------------------------------------------------------------------------------


def attempt_class(spark, sf):
    df = blocking.classify_attempts(derived.attempts(spark, sf))
    return df.select("attempt_id", "domain", "is_blocking")


def block_windows(spark, sf):
    df = blocking.block_windows(derived.attempts(spark, sf))
    return df.select(
        "egress", "attempt_id", "is_blocking", "total_attempts", "blocking_failures", "blocking_rate", "unique_domains",
        _joined("affected_domains").alias("affected_domains"), "retry_queue_size", "is_blocked",
    )


def _alert_text(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", "egress", "attempt_id", ts_text(F.col("ts")).alias("ts"), "blocking_failures", "total_attempts",
        "blocking_rate", "unique_domains", _joined("affected_domains").alias("affected_domains"), "retry_queue_size",
    )


def block_alerts(spark, sf):
    return _alert_text(blocking.block_alerts(derived.attempts(spark, sf)))


def retry_queue(spark, sf):
    df = blocking.retry_queue(derived.attempts(spark, sf))
    return df.select("egress", "queue_pos", "attempt_id", "url")


# --- streams --------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, all of it in one micro-batch.

    A table at rest has no order of arrival, and after a first part the watermark would drop older rows of a second.
    """
    schema = derived.table(spark, sf, name).schema
    # As a pattern the path may name one file or a folder of files; a plain one must be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, through a file sink, and read back what it wrote."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    stream_detection.run_to_files(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that keyed state needs, for the queries started inside; the caller's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _updated(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over what is there and read back the last state of each key."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    stream_progress.upsert_files(stream, path, checkpoint).awaitTermination()
    return stream_progress.latest(spark, stream.schema, path, keys)


def stream_detection_query(spark, sf):
    sites = derived.derive_sites(_stream(spark, sf, "pages"))
    return _result_text(_drained(stream_detection.stream_detect(sites), "stream-detection"))


def stream_block_alerts(spark, sf):
    """The log as it comes, then its end: the second run lets go of the attempts that still wait."""
    attempts = derived.derive_attempts(_stream(spark, sf, "events"))
    markers = scratch_path(spark, "stream-alerts-end")
    alerts = stream_blocking.stream_block_alerts(stream_blocking.end_markers(attempts, markers))
    path, checkpoint = scratch_path(spark, "stream-alerts"), scratch_path(spark, "stream-alerts-state")
    with _rocksdb(spark):
        stream_detection.run_to_files(alerts, path, checkpoint).awaitTermination()
        stream_blocking.end_log(attempts, markers)
        stream_detection.run_to_files(alerts, path, checkpoint).awaitTermination()
    return _alert_text(spark.read.schema(alerts.schema).parquet(path))


def stream_retry_queue(spark, sf):
    """The queue as the stream leaves it, from the same state that the alerts read."""
    attempts = derived.derive_attempts(_stream(spark, sf, "events"))
    queue = stream_blocking.stream_retry_queue(attempts)
    with _rocksdb(spark):
        df = _updated(queue, "stream-queue", ["run_id", "egress", "queue_pos"])
    return df.select("egress", "queue_pos", "attempt_id", "url")


def stream_dedup(spark, sf):
    urls = derived.derive_attempts(_stream(spark, sf, "events")).select("ts", "original_url")
    with _rocksdb(spark):
        return _drained(stream_inputs.stream_dedup(urls), "stream-dedup").select("original_url")


def _sunk(spark, sf) -> str:
    """The folder of a run into all sinks; every tenth page's fetch counts as failed."""
    rows = stream_detection.stream_detect(derived.derive_sites(_stream(spark, sf, "pages")))
    rows = rows.withColumn("error", F.when(F.col("page_id") % 10 == 9, "no answer"))
    folder, checkpoint = scratch_path(spark, "stream-sinks"), scratch_path(spark, "stream-sinks-state")
    stream_sinks.run_to_sinks(rows, folder, checkpoint).awaitTermination()
    return folder


def stream_outputs(spark, sf):
    """Per URL how often it is in each committed output of the run."""
    folder = _sunk(spark, sf)
    parts = []
    for output in (stream_sinks.LINES, stream_sinks.FAILED, stream_sinks.COMPLETED):
        rows = stream_sinks.read_committed(spark, folder, output)
        url = F.col("value") if output == stream_sinks.COMPLETED else F.get_json_object("value", "$.original_url")
        parts.append(rows.select(url.alias("original_url"), F.lit(output).alias("output")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    times = lambda name: F.count_if(F.col("output") == name).alias(name)
    return every.groupBy("original_url").agg(*[times(n) for n in (stream_sinks.LINES, stream_sinks.FAILED, stream_sinks.COMPLETED)])


def stream_statistics(spark, sf):
    return stream_sinks.committed_statistics(spark, _sunk(spark, sf))


def stream_progress_query(spark, sf):
    attempts = derived.derive_attempts(_stream(spark, sf, "events"))
    df = _updated(stream_progress.stream_progress(attempts), "stream-progress", ["run_id", "window_start"])
    return df.withColumn("window_start", ts_text(F.col("window_start")))


def stream_stalls(spark, sf):
    attempts = derived.derive_attempts(_stream(spark, sf, "events"))
    spans = _updated(stream_progress.stream_spans(attempts), "stream-spans", ["run_id", "interval"])
    return _stall_text(stream_progress.stalls_of(spans))


QUERIES = {
    "url_list_clean": url_list_clean,
    "url_inputs_union": url_inputs_union,
    "url_dedup": url_dedup,
    "resume_pending": resume_pending,
    "run_reconcile": run_reconcile,
    "url_normalized": url_normalized,
    "url_domain": url_domain_query,
    "url_variations": url_variations_query,
    "domain_waves": domain_waves,
    "page_resources": page_resources_query,
    "page_metadata": page_metadata,
    "final_url_rule": final_url_rule,
    "network_log_flat": network_log_flat,
    "html_evidence": html_evidence,
    "network_evidence": network_evidence,
    "cookie_evidence": cookie_evidence,
    "evidence_all": evidence_all,
    "catalog_theta_join": catalog_theta_join,
    "catalog_index_join": catalog_index_join,
    "catalog_profile": catalog_profile,
    "evidence_by_category": evidence_by_category,
    "prefilter_parity": prefilter_parity,
    "detection_result": detection_result,
    "summary_flags": summary_flags,
    "confidence_level": confidence_level,
    "detected_flag": detected_flag,
    "hub_ids_by_page": hub_ids_by_page,
    "multi_portal_pages": multi_portal_pages,
    "result_flat": result_flat,
    "result_json": result_json,
    "failure_results": failure_results,
    "completed_urls": completed_urls,
    "result_violations": result_violations,
    "json_violations": json_violations,
    "result_url_variation": result_url_variation,
    "run_statistics": run_statistics,
    "run_status_json": run_status_json,
    "confidence_distribution": confidence_distribution,
    "hub_id_usage": hub_id_usage,
    "progress_snapshots": progress_snapshots,
    "progress_by_window": progress_by_window,
    "stall_gaps": stall_gaps,
    "stall_open": stall_open,
    "retry_plan": retry_plan,
    "resolved_url": resolved_url,
    "attempt_class": attempt_class,
    "block_windows": block_windows,
    "block_alerts": block_alerts,
    "retry_queue": retry_queue,
    "stream_detection": stream_detection_query,
    "stream_block_alerts": stream_block_alerts,
    "stream_retry_queue": stream_retry_queue,
    "stream_dedup": stream_dedup,
    "stream_outputs": stream_outputs,
    "stream_statistics": stream_statistics,
    "stream_progress": stream_progress_query,
    "stream_stalls": stream_stalls,
}
