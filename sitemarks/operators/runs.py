"""Run analytics: statistics, distributions, reconciliation, progress, stalls, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.functions.durations import clock_time
from sitemarks.operators.ordered import join_null_safe, with_running_totals
from sitemarks.session import written
from sitemarks.sources.catalog import CONFIDENCE_LEVELS

#: Statistics column -> result flag. Legacy call-to-action hits are not counted.
COUNTED_FLAGS = {
    "tracking_count": "tracking",
    "cms_count": "cms_hosting",
    "forms_count": "forms",
    "chat_count": "chat",
    "video_count": "video",
    "meetings_count": "meetings",
    "email_count": "email_tracking",
}
STALL_SECONDS = 600
BACKOFF_SECONDS, BACKOFF_FACTOR, RATE_LIMIT_SECONDS = 5, 3, 120
TRANSIENT = ("timeout", "connection", "network", "dns", "5")


def result_counters() -> dict[str, Column]:
    """Per result row, what it adds to each counter. Detections count on successes only."""
    ok = F.col("error").isNull()
    return {
        "completed": F.lit(1),
        "success_count": ok.cast("int"),
        "failure_count": (~ok).cast("int"),
        "found_count": (ok & F.col("hubspot_detected")).cast("int"),
        **{name: (ok & F.col(flag)).cast("int") for name, flag in COUNTED_FLAGS.items()},
        **{f"{level}_count": (ok & (F.col("confidence") == level)).cast("int") for level in CONFIDENCE_LEVELS},
    }


def run_statistics(results: DataFrame, total_urls: int | None = None, elapsed_seconds: float | None = None) -> DataFrame:
    """One row of run counters with rate, percentage and time left.

    One pass over the results: rows are first grouped by account id (a failed or
    id-less result under NULL) with map-side combine, then summed, so distinct
    ids need no second evaluation of the detection. ``total_urls`` defaults to
    the number of results, ``elapsed_seconds`` to the span of their times.
    """
    counters = result_counters()
    ids = F.when(F.col("error").isNull(), F.col("hub_ids"))
    rows = results.select(*[c.alias(n) for n, c in counters.items()], "fetched_at", F.posexplode_outer(ids).alias("_pos", "_id"))
    once = F.coalesce("_pos", F.lit(0)) == 0
    by_id = rows.groupBy("_id").agg(
        *[F.sum(F.when(once, F.col(n)).otherwise(0)).alias(n) for n in counters],
        F.min("fetched_at").alias("_first"),
        F.max("fetched_at").alias("_last"),
    )
    df = by_id.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counters],
        F.count("_id").alias("unique_hub_ids"),
        (F.unix_micros(F.max("_last")) - F.unix_micros(F.min("_first"))).alias("_micros"),
    )
    return with_rates(df, total_urls, elapsed_seconds)


def with_rates(counts: DataFrame, total_urls: int | None, elapsed_seconds: float | None) -> DataFrame:
    """Counters with ``_micros``, the span of the results' times, to statistics."""
    total = F.col("completed") if total_urls is None else F.lit(total_urls)
    elapsed = F.coalesce(F.col("_micros"), F.lit(0)) / 1e6 if elapsed_seconds is None else F.lit(float(elapsed_seconds))
    return _with_rates(counts.withColumns({"total_urls": total.cast("bigint"), "elapsed_seconds": elapsed}).drop("_micros"))


def _with_rates(df: DataFrame) -> DataFrame:
    """Add ``rate``, ``eta_seconds`` and ``percentage``; 0 where undefined."""
    df = df.withColumn(
        "rate", F.when(F.col("elapsed_seconds") > 0, F.col("completed") / F.col("elapsed_seconds")).otherwise(0.0)
    )
    return df.withColumns(
        {
            "eta_seconds": F.when(
                F.col("rate") > 0, (F.col("total_urls") - F.col("completed")) / F.col("rate")
            ).otherwise(0.0),
            "percentage": F.when(
                F.col("total_urls") > 0, F.col("completed") / F.col("total_urls") * 100
            ).otherwise(0.0),
        }
    )


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0)


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def status_lines(stats: DataFrame) -> DataFrame:
    """Statistics rows as ``compact``, ``detailed`` and ``json`` status text."""
    text = lambda name: F.col(name).cast("string")
    head = F.concat(
        F.lit("Progress: "), text("completed"), F.lit("/"), text("total_urls"), F.lit(" ("),
        _one_decimal(F.col("percentage")), F.lit("%) | Success: "), text("success_count"), F.lit(" | Failed: "),
        text("failure_count"), F.lit(" | Rate: "), _one_decimal(F.col("rate")), F.lit(" URL/s | Elapsed: "),
        clock_time(F.col("elapsed_seconds")), F.lit(" | ETA: "), clock_time(F.col("eta_seconds")),
    )
    found = F.concat(
        F.lit("HubSpot Found: "), text("found_count"), F.lit("/"), text("success_count"), F.lit(" ("),
        _one_decimal(_percent("found_count", "success_count")), F.lit("%)"),
    )
    ids = F.concat(F.lit("Hub IDs: "), text("unique_hub_ids"), F.lit(" unique"))
    pairs = lambda names: F.concat_ws(
        " | ", *[F.concat(F.lit(f"{label}: "), text(column)) for label, column in names.items()]
    )
    features = pairs({"Tracking": "tracking_count", "CMS": "cms_count", "Forms": "forms_count", "Chat": "chat_count"})
    levels = pairs({level.capitalize(): f"{level}_count" for level in CONFIDENCE_LEVELS})
    any_success = F.col("success_count") > 0
    compact = F.when(any_success, F.concat(head, F.lit("\n"), F.concat_ws(" | ", found, ids))).otherwise(head)
    detailed = F.when(
        any_success,
        F.concat(
            head, F.lit("\n"), F.concat_ws(" | ", found, features), F.lit("\nConfidence: "), F.concat_ws(" | ", levels, ids)
        ),
    ).otherwise(head)
    rounded = lambda name: F.bround(F.col(name), 2)
    json = F.to_json(
        F.struct(
            F.struct(
                F.col("completed"), F.col("total_urls").alias("total"), rounded("percentage").alias("percentage"),
                F.col("success_count").alias("success"), F.col("failure_count").alias("failed"),
            ).alias("progress"),
            F.struct(
                rounded("rate").alias("rate_urls_per_sec"), rounded("elapsed_seconds").alias("elapsed_seconds"),
                rounded("eta_seconds").alias("eta_seconds"),
            ).alias("performance"),
            F.struct(
                F.col("found_count").alias("found"),
                *[F.col(name).alias(name.removesuffix("_count")) for name in COUNTED_FLAGS],
                F.col("unique_hub_ids"),
            ).alias("hubspot_detection"),
            F.struct(*[F.col(f"{level}_count").alias(level) for level in CONFIDENCE_LEVELS]).alias("confidence"),
        )
    )
    return stats.select("*", compact.alias("compact"), detailed.alias("detailed"), json.alias("json"))


def confidence_distribution(results: DataFrame) -> DataFrame:
    """Successful results per confidence level."""
    return results.filter("error IS NULL").groupBy("confidence").agg(F.count("*").alias("n_results"))


def hub_id_usage(results: DataFrame) -> DataFrame:
    """Distinct account ids of a run with the number of pages that carry each."""
    ids = results.filter("error IS NULL").select(F.explode("hub_ids").alias("hub_id"))
    return ids.groupBy("hub_id").agg(F.count("*").alias("n_pages"))


def distinct_hub_ids(results: DataFrame, approximate: bool = False) -> DataFrame:
    """One row with the number of distinct account ids, optionally by sketch."""
    ids = results.filter("error IS NULL").select(F.explode("hub_ids").alias("hub_id"))
    count = F.approx_count_distinct("hub_id") if approximate else F.count_distinct("hub_id")
    return ids.agg(count.alias("unique_hub_ids"))


def evidence_by_category(evidence: DataFrame, top: int | None = None) -> DataFrame:
    """Evidence rows and pages per category and pattern; ``top`` keeps the most frequent for a report.

    Pages are counted in two combining steps, so a frequent pattern is never one task's set of ids.
    """
    per_page = evidence.groupBy("category", "pattern_id", "page_id").agg(F.count("*").alias("_n"))
    df = per_page.groupBy("category", "pattern_id").agg(
        F.sum("_n").alias("n_evidence"), F.count("*").alias("n_pages")
    )
    if top is None:
        return df
    return df.orderBy(F.desc("n_evidence"), "category", "pattern_id").limit(top)


def run_reconcile(inputs: DataFrame, completed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row accounting for every input URL of a run.

    The three lists are tagged and unioned, then combined per URL in one
    shuffle. ``n_remaining`` counts what is not completed (failures may be tried
    again), ``n_overlap`` URLs both completed and failed, ``n_log_duplicates``
    repeated log lines, ``n_unknown`` logged URLs that were never an input.
    """

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select("original_url", F.lit(tag).alias("tag"))

    union = tagged(inputs, "input").unionByName(tagged(completed, "completed")).unionByName(tagged(failed, "failed"))
    urls = union.groupBy("original_url").agg(
        *[F.count_if(F.col("tag") == t).alias(t) for t in ("input", "completed", "failed")]
    )
    is_input, done, bad = F.col("input") > 0, F.col("completed") > 0, F.col("failed") > 0
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return urls.agg(
        zero("input").alias("n_total"),
        F.count_if(is_input).alias("n_unique"),
        F.count_if(is_input & done).alias("n_completed"),
        F.count_if(is_input & bad).alias("n_failed"),
        F.count_if(is_input & ~done).alias("n_remaining"),
        F.count_if(done & bad).alias("n_overlap"),
        zero(F.greatest(F.col("completed") - 1, F.lit(0))).alias("n_log_duplicates"),
        F.count_if(~is_input).alias("n_unknown"),
    )


def progress_snapshots(
    results: DataFrame, every: int = 10, total_urls: int | None = None, run_id: str = "run_id"
) -> DataFrame:
    """Running counters of each run at every ``every``-th completion and at the last one there is.

    ``total_urls`` only tells what the counters are held against: a run that has fewer
    rows so far still ends with the snapshot of its last one.

    ``results`` carries a run column and each original URL once per run (inputs are
    deduplicated before a run). Completion order is ``fetched_at``, then the original URL.
    """
    measures = result_counters()
    order = ["fetched_at", "original_url"]
    # Detection is evaluated once: all steps below read this narrow written table.
    narrow = written(
        results.select(
            run_id, *order, *[c.alias(f"_{n}") for n, c in measures.items()],
            F.when(F.col("error").isNull(), F.col("hub_ids")).alias("_ids"),
        ),
        "completions",
    )
    ids = narrow.select(run_id, *order, F.explode("_ids").alias("_id"))
    first_seen = ids.groupBy(run_id, "_id").agg(F.min(F.struct(*order)).alias("_at"))
    new_ids = first_seen.groupBy(run_id, *[F.col(f"_at.{c}").alias(c) for c in order]).agg(
        F.count("*").alias("_new_ids")
    )
    steps = join_null_safe(narrow.drop("_ids"), new_ids, [run_id, *order], "left")
    sums = {n: F.col(f"_{n}") for n in measures}
    sums["unique_hub_ids"] = F.coalesce("_new_ids", F.lit(0))
    running = with_running_totals(steps, [run_id], order, sums)
    sizes = narrow.groupBy(run_id).agg(F.count("*").alias("_size"))
    df = join_null_safe(running, sizes, [run_id])
    df = df.withColumn("total_urls", F.col("_size") if total_urls is None else F.lit(total_urls).cast("bigint"))
    due = (F.col("completed") % every == 0) | (F.col("completed") == F.col("_size"))
    return df.filter(due).select(run_id, "fetched_at", "total_urls", *sums)


def completed_and_failed() -> tuple[Column, Column]:
    """Counts of attempts; one whose ``success`` is NULL has not succeeded, so it has failed."""
    ok = F.coalesce("success", F.lit(False))
    return F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed")


def progress_by_window(
    attempts: DataFrame, width: str = "1 hour", total_urls: int | None = None
) -> DataFrame:
    """Completed and failed attempts per run and tumbling window, with cumulative progress.

    The window runs over aggregated intervals, so it is bounded by the time span
    of a run and not by its rows. ``remaining`` does not subtract failures: they
    may be tried again. ``total_urls`` defaults to all attempts of the run.
    """
    counts = attempts.groupBy("run_id", F.window("ts", width).alias("w")).agg(*completed_and_failed())
    run = Window.partitionBy("run_id")
    upto = run.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("completed") + F.col("failed")).over(run) if total_urls is None else F.lit(total_urls)
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    df = counts.select(
        "run_id",
        F.col("w.start").alias("window_start"),
        "completed",
        "failed",
        F.sum("completed").over(upto).alias("total_completed"),
        F.sum("failed").over(upto).alias("total_failed"),
        total.cast("bigint").alias("total_urls"),
        (F.col("completed") / (seconds / 1e6)).alias("rate"),
    )
    remaining = F.col("total_urls") - F.col("total_completed")
    return df.withColumns(
        {
            "total_processed": F.col("total_completed") + F.col("total_failed"),
            "remaining": remaining,
            "progress_pct": F.when(F.col("total_urls") > 0, F.col("total_completed") / F.col("total_urls") * 100).otherwise(0.0),
            "eta_seconds": F.when(F.col("rate") > 0, remaining / F.col("rate")),
        }
    )


def stall_gaps(attempts: DataFrame, threshold_seconds: int = STALL_SECONDS, now: str | None = None) -> DataFrame:
    """Stretches of more than ``threshold_seconds`` without any completion or failure.

    Rows are reduced to the first and last event per interval of the threshold's
    length. Two events in one interval are never a stall apart, so only gaps
    between neighbouring intervals are compared, and no run is sorted row by row.
    ``now`` (a timestamp) also reports a stall that is still going on.
    """
    micros = F.unix_micros("ts")
    bucket = F.floor(micros / (threshold_seconds * 1_000_000))
    spans = attempts.groupBy("run_id", bucket.alias("_bucket")).agg(F.min("ts").alias("_min"), F.max("ts").alias("_max"))
    return gaps_between(spans, "_bucket", "_min", "_max", threshold_seconds, now)


def gaps_between(
    spans: DataFrame, interval: str, first: str, last: str, threshold_seconds: int, now: str | None = None
) -> DataFrame:
    """Stalls between the first and last events of a run's intervals; see ``stall_gaps``."""
    ahead = Window.partitionBy("run_id").orderBy(interval)
    upcoming = F.lead(first).over(ahead)
    if now is not None:
        upcoming = F.coalesce(upcoming, F.lit(now).cast("timestamp"))
    df = spans.select("run_id", F.col(last).alias("last_update"), upcoming.alias("next_update"))
    stalled = F.unix_micros("next_update") - F.unix_micros("last_update")
    return df.withColumn("stall_seconds", stalled / 1e6).filter(stalled > threshold_seconds * 1_000_000)


def retry_plan(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """What follows each attempt, read from the text of its error (as entered, URL included).

    ``decision``: ``success``, ``rate_limited``, ``forbidden``, ``retry`` or
    ``give_up``; ``wait_seconds`` before going on; ``last_status`` as far as the
    text tells. ``retry_no`` counts from 0.
    """
    text = F.lower(F.coalesce("error", F.lit("")))

    def mentions(*words: str) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        return hit

    decision = (
        F.when(F.coalesce("success", F.lit(False)), "success")
        .when(mentions("429", "too many requests"), "rate_limited")
        .when(mentions("403", "forbidden"), "forbidden")
        .when((F.col("retry_no") < max_retries - 1) & mentions(*TRANSIENT), "retry")
        .otherwise("give_up")
    )
    df = attempts.withColumn("decision", decision)
    backoff = (F.lit(BACKOFF_SECONDS) * F.pow(F.lit(BACKOFF_FACTOR), F.col("retry_no"))).cast("bigint")
    return df.withColumns(
        {
            "wait_seconds": F.when(F.col("decision") == "retry", backoff)
            .when(F.col("decision") == "rate_limited", F.lit(RATE_LIMIT_SECONDS).cast("bigint"))
            .otherwise(F.lit(0).cast("bigint")),
            "last_status": F.when(F.col("decision") == "rate_limited", 429).when(F.col("decision") == "forbidden", 403),
        }
    )


def resolved_urls(inputs: DataFrame, attempts: DataFrame) -> DataFrame:
    """For each input, the first attempt that succeeded in priority order; NULLs when none did.

    Attempts are combined per input before the join, so neither side has hot keys.
    ``variation_type`` is set when the URL that worked is not the one entered first.
    """
    best = (
        attempts.filter("success")  # a NULL is no success
        .groupBy("original_url")
        .agg(F.min(F.struct("variation_no", "retry_no", "attempt_id", "url")).alias("_b"))
        .select("original_url", F.col("_b.url").alias("working_url"), F.col("_b.variation_no").alias("variation_no"))
    )
    joined = inputs.select("original_url").join(best, "original_url", "left")
    return joined.withColumn("variation_type", F.when(F.col("variation_no") > 0, "auto"))
