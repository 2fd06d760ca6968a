"""The same queries in plain SQL for a single-node engine (DuckDB dialect).

Only literals are shared with the Spark side (signature texts, rule tables,
snippets, lookup values); how results are derived from them is written anew,
relationally: joins, unions and windows instead of arrays.
"""

from __future__ import annotations

from sitemarks.plans import derived as d
from sitemarks.plans.queries import MAX_PER_DOMAIN, MAX_RETRIES, SNAPSHOT_EVERY
from sitemarks.sources.catalog import load_catalog


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


CATALOG = load_catalog()
RX = {name: q(regex) for name, regex in CATALOG.patterns.items()}
FLAGS = {
    "tracking": "category = 'tracking' OR (category = 'cookies' AND contains(lower(match), 'hubspotutk'))",
    "cms_hosting": "category = 'cms' AND confidence IN ('strong', 'definitive')",
    "forms": "category = 'forms'",
    "chat": "category = 'chat'",
    "ctas_legacy": "category = 'ctas'",
    "meetings": "category = 'meetings'",
    "video": "category = 'video'",
    "email_tracking": "category = 'email'",
}
FLAG_NAMES = ", ".join(FLAGS)


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def normalized(url: str) -> str:
    return f"CASE WHEN regexp_matches({url}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {url} ELSE 'https://' || {url} END"


# --- derived views ----------------------------------------------------------------------------------

SITES = f"""
sites AS (
  SELECT page_id, original_url, {normalized('original_url')} AS requested_url,
         CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS http_status,
         replace(html, '</head>', ({_list(d.SNIPPETS)})[page_id % 16 + 1] || '</head>') AS html,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS fetched_at,
         ({_list(h[0] if h else None for h in d.COOKIE_HEADERS)})[page_id % 5 + 1] AS cookie_header,
         ({_list(h[1] if h else None for h in d.COOKIE_HEADERS)})[page_id % 5 + 1] AS cookie
  FROM (SELECT *, CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '^https://', '') ELSE url END AS original_url
        FROM pages))"""

NETWORK = f"""
network AS (SELECT page_id, 0 AS pos, ({_list(d.NETWORK_URLS)})[page_id % 11 + 1] AS url FROM pages)"""


def _outcome(index: int) -> str:
    def value(x):
        return q(x) if isinstance(x, str) else "NULL" if x is None else str(x).lower()

    return "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {value(v[index])}" for k, v in d.ATTEMPT_OUTCOMES.items()) + " END"


ATTEMPTS = f"""
attempts AS (
  SELECT 'r1' AS run_id, CAST(user_id % 8 AS VARCHAR) AS egress, event_id AS attempt_id, ts,
         'https://d' || user_id || '.example.com/p' || (event_id % 13) AS url,
         'd' || user_id || '.example.com/p' || (event_id % 13) AS original_url,
         'd' || user_id || '.example.com' AS domain,
         CAST(event_id % 4 AS INTEGER) AS variation_no, CAST(event_id % 3 AS INTEGER) AS retry_no,
         {_outcome(0)} AS success, {_outcome(1)} AS status_code, {_outcome(2)} AS error,
         event_type IN ('error', 'click', 'view') AS is_blocking
  FROM events)"""

INPUTS = f"""
lines AS (
  SELECT page_id AS input_pos, url AS line FROM pages
  UNION ALL SELECT {d.INPUT_STEP} + page_id, url FROM pages WHERE page_id % 7 = 0
  UNION ALL SELECT {2 * d.INPUT_STEP} + page_id, '# ' || url FROM pages WHERE page_id % 11 = 0
  UNION ALL SELECT {3 * d.INPUT_STEP} + page_id, '  ' || url || ' ' FROM pages WHERE page_id % 13 = 0
  UNION ALL SELECT {4 * d.INPUT_STEP} + page_id, '' FROM pages WHERE page_id % 17 = 0
  UNION ALL SELECT {5 * d.INPUT_STEP} + page_id, regexp_replace(url, '^https?://', '') FROM pages WHERE page_id % 5 = 0),
inputs AS (SELECT input_pos, trim(line) AS original_url FROM lines WHERE trim(line) <> '' AND trim(line)[1] <> '#'),
done AS (
  SELECT url AS original_url FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT url FROM pages WHERE page_id % 15 = 0),
failed AS (SELECT url AS original_url FROM pages WHERE page_id % 7 = 1)"""


# --- evidence ---------------------------------------------------------------------------------------


def _html_rule(number: int, rule) -> str:
    rx = RX[rule.pattern]
    where = [f"regexp_matches(html, {rx}, 'i')"]
    if rule.requires:
        where.append(f"regexp_matches(html, {RX[rule.requires]}, 'i')")
    if rule.unless:
        where.append(f"NOT regexp_matches(html, {RX[rule.unless]}, 'i')")
    level = q(rule.confidence)
    if rule.upgrade_if:
        level = f"CASE WHEN regexp_matches(html, {RX[rule.upgrade_if]}, 'i') THEN {q(rule.upgrade_to)} ELSE {level} END"
    hub_id = "CAST(NULL AS BIGINT)"
    if rule.id_group:
        hub_id = f"TRY_CAST(nullif(regexp_extract(html, {rx}, {rule.id_group}, 'i'), '') AS BIGINT)"
    if rule.match_all:
        found = f"regexp_extract_all(html, {rx}, 0, 'i')"
        source = f"(SELECT page_id, html, unnest({found}) AS m, generate_subscripts({found}, 1) AS sub FROM sites)"
        match, sub, where = "m", "sub", ["true"]
    else:
        source, match, sub = "sites", f"regexp_extract(html, {rx}, 0, 'i')", "1"
    return (
        f"SELECT page_id, {number} AS ord, {sub} AS sub, {q(rule.category)} AS category, {q(rule.pattern_id)} AS pattern_id, "
        f"substr({match}, 1, 300) AS match, 'html' AS source, {hub_id} AS hub_id, {level} AS confidence "
        f"FROM {source} WHERE {' AND '.join(where)}"
    )


HTML_EV = "html_ev AS (" + "\nUNION ALL ".join(_html_rule(i, r) for i, r in enumerate(CATALOG.rules["html"], 1)) + ")"


def _url_rule(number: int, rule, table: str) -> str:
    rx = RX[rule.pattern]
    hub_id = "CAST(NULL AS BIGINT)"
    if rule.id_fallback:
        direct = f"TRY_CAST(nullif(regexp_extract(url, {rx}, 1, 'i'), '') AS BIGINT)" if rule.id_group else "NULL"
        other = f"TRY_CAST(nullif(regexp_extract(url, {q(CATALOG.id_fallback)}, 1, 'i'), '') AS BIGINT)"
        hub_id = f"coalesce(nullif({direct}, 0), {other}, {direct})"
    return (
        f"SELECT page_id, pos, {number} AS rule_pos, {q(rule.category)} AS category, {q(rule.pattern_id)} AS pattern_id, "
        f"substr(url, 1, 300) AS match, 'url' AS source, {hub_id} AS hub_id, {q(rule.confidence)} AS confidence "
        f"FROM {table} WHERE regexp_matches(url, {rx}, 'i')"
    )


def _url_ev(name: str, table: str) -> str:
    """Rule hits per URL; ``rule_pos`` is the position among the hits of the URL."""
    union = "\nUNION ALL ".join(_url_rule(i, r, table) for i, r in enumerate(CATALOG.rules["url"], 1))
    return (
        f"{name} AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, pos ORDER BY rule_pos) AS rule_pos, "
        f"category, pattern_id, match, source, hub_id, confidence FROM ({union}))"
    )


_COOKIES = f"regexp_extract_all(cookie, {RX['cookie_any']}, 0, 'i')"
COOKIE_EV = f"""
cookie_ev AS (
  SELECT page_id, sub AS seq, 'cookies' AS category, 'cookie_any' AS pattern_id, m AS match, 'header' AS source,
         CAST(NULL AS BIGINT) AS hub_id, CASE WHEN lower(m) = 'hubspotutk' THEN 'definitive' ELSE 'strong' END AS confidence
  FROM (SELECT page_id, unnest({_COOKIES}) AS m, generate_subscripts({_COOKIES}, 1) AS sub FROM sites WHERE cookie IS NOT NULL))"""


def _tags(tags: str) -> str:
    """Links of the given tags in document order: ``page_id, sub, link``."""
    found = f"regexp_extract_all(html, '<(?:{tags})\\s[^>]*>')"
    return f"""
    SELECT page_id, requested_url, sub, replace(regexp_extract(tag,
             CASE WHEN regexp_matches(tag, '^<(?:link|a)\\s') THEN '\\shref=["'']([^"'']*)["'']'
                  ELSE '\\ssrc=["'']([^"'']*)["'']' END, 1), '&amp;', '&') AS link
    FROM (SELECT page_id, requested_url, unnest({found}) AS tag, generate_subscripts({found}, 1) AS sub FROM sites)"""


def _resources(name: str, tags: str) -> str:
    return f"""
{name}_links AS ({_tags(tags)}),
{name} AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(sub)) AS pos, url
  FROM (SELECT page_id, sub, CASE
          WHEN regexp_matches(link, '^[a-z]+:') THEN link
          WHEN link[1:2] = '//' THEN regexp_extract(requested_url, '^([a-z]+:)', 1) || link
          WHEN link[1] = '/' THEN regexp_extract(requested_url, '^([a-z]+://[^/?#]*)', 1) || link
          WHEN link[1] = '#' THEN regexp_replace(requested_url, '#.*$', '') || CASE WHEN link = '#' THEN '' ELSE link END
          ELSE regexp_extract(requested_url, '^([a-z]+://[^?#]*/)', 1) || link END AS url
        FROM {name}_links WHERE link <> '')
  GROUP BY page_id, url)"""


def _first(source: str) -> str:
    """First evidence per page and key of rows with a ``rank_no``."""
    return f"""
    SELECT * EXCLUDE (nth) FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, category, pattern_id, source, match ORDER BY rank_no) AS nth
      FROM ({source})) WHERE nth = 1"""


_EV_COLUMNS = "category, pattern_id, match, source, hub_id, confidence"


def _all_evidence(name: str, url_table: str) -> str:
    union = (
        f"SELECT page_id, ord * 1000000 + sub AS rank_no, {_EV_COLUMNS} FROM html_ev UNION ALL "
        f"SELECT page_id, 1000000000000 + pos * 1000 + rule_pos, {_EV_COLUMNS} FROM {url_table}"
    )
    return f"""
{name} AS ({_first(union)}
  UNION ALL SELECT page_id, 2000000000000 + seq, {_EV_COLUMNS} FROM cookie_ev)"""


#: Rendered pages: requests come from the network table.
RENDERED = ",".join([SITES, NETWORK, HTML_EV, _url_ev("url_ev", "network"), COOKIE_EV, _all_evidence("evidence", "url_ev")])
#: Static pages: requests are the page's own resources.
STATIC = ",".join(
    [SITES, HTML_EV, _resources("resources", "script|link|iframe"), _url_ev("url_ev", "resources"), COOKIE_EV,
     _all_evidence("evidence", "url_ev")]
)


def _summary(source: str = "sites") -> str:
    flags = ", ".join(f"coalesce(bool_or({c}), false) AS {n}" for n, c in FLAGS.items())
    return f"""
flags AS (
  SELECT s.page_id, {flags},
         coalesce(bool_or(pattern_id = 'tracking_loader_script' AND confidence = 'definitive'), false) AS loader,
         coalesce(bool_or(confidence IN ('strong', 'definitive')), false) AS sure, count(e.page_id) AS evidence_count
  FROM {source} s LEFT JOIN evidence e USING (page_id) GROUP BY s.page_id),
summary AS (
  SELECT page_id, {FLAG_NAMES}, evidence_count,
         CASE WHEN tracking AND loader THEN 'definitive' WHEN tracking THEN 'strong'
              WHEN sure THEN 'moderate' ELSE 'weak' END AS confidence,
         ({' OR '.join(FLAGS)}) AS hubspot_detected
  FROM flags),
ids AS (
  SELECT page_id, string_agg(CAST(hub_id AS VARCHAR), ',' ORDER BY rank_no) AS hub_ids, count(*) AS hub_id_count
  FROM (SELECT page_id, hub_id, min(rank_no) AS rank_no FROM evidence WHERE hub_id IS NOT NULL GROUP BY ALL)
  GROUP BY page_id)"""


_TITLE = "nullif(trim(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')), '')"
RESULTS = f"""
results AS (
  SELECT page_id, original_url, CASE WHEN http_status >= 400 THEN original_url ELSE requested_url END AS final_url,
         fetched_at, hubspot_detected, coalesce(hub_ids, '') AS hub_ids, coalesce(hub_id_count, 0) AS hub_id_count,
         {FLAG_NAMES}, confidence, evidence_count, http_status, {_TITLE} AS page_title,
         CAST(NULL AS VARCHAR) AS page_description, CAST(NULL AS VARCHAR) AS error, cookie_header, cookie
  FROM sites JOIN summary USING (page_id) LEFT JOIN ids USING (page_id))"""

FAILURES = f"""
failed_urls AS (
  SELECT original_url, max(ts) AS fetched_at, 'https://' || original_url AS first
  FROM attempts GROUP BY original_url HAVING NOT bool_or(success)),
failures AS (
  SELECT CAST(NULL AS BIGINT) AS page_id, original_url, original_url AS final_url, fetched_at, false AS hubspot_detected,
         '' AS hub_ids, 0 AS hub_id_count, {', '.join(f'false AS {f}' for f in FLAGS)}, 'weak' AS confidence,
         0 AS evidence_count, CAST(NULL AS INTEGER) AS http_status, CAST(NULL AS VARCHAR) AS page_title,
         CAST(NULL AS VARCHAR) AS page_description, 'Failed after all retry attempts and 3 URL variations' AS error,
         CAST(NULL AS VARCHAR) AS cookie_header, CAST(NULL AS VARCHAR) AS cookie
  FROM failed_urls)"""

RUN = ",".join([STATIC, _summary(), RESULTS, ATTEMPTS, FAILURES]) + """,
run AS (SELECT * FROM results UNION ALL SELECT * FROM failures)"""


def with_(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body}"


_ITEM = "concat_ws(':', category, pattern_id, source, confidence, coalesce(CAST(hub_id AS VARCHAR), '-'), match)"
DETECTION = with_(
    ",".join([STATIC, _summary(), RESULTS]),
    f"""
SELECT page_id, original_url, final_url, {ts('fetched_at')} AS fetched_at, http_status, hubspot_detected, hub_ids,
       {FLAG_NAMES}, confidence, coalesce(texts.evidence, '') AS evidence, page_title, page_description
FROM results LEFT JOIN (SELECT page_id, string_agg({_ITEM}, ' | ' ORDER BY rank_no) AS evidence
                        FROM evidence GROUP BY page_id) texts USING (page_id)""",
)

_ISO = "strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(fetched_at) % 1000000 = 0 THEN '' ELSE strftime(fetched_at, '.%f') END || 'Z'"

_JSON_FEATURES = (
    "{'forms': forms, 'chat': chat, 'ctasLegacy': ctas_legacy, 'meetings': meetings, 'video': video, "
    "'emailTrackingIndicators': email_tracking}"
)
_JSON_HEAD = (
    f"'original_url': original_url, 'final_url': final_url, 'timestamp': {_ISO}, 'hubspot_detected': hubspot_detected, "
    "'hubIds': coalesce(id_list, []), 'summary': {'tracking': tracking, 'cmsHosting': cms_hosting, "
    f"'features': {_JSON_FEATURES}, 'confidence': confidence}}, 'evidence': coalesce(items, []), "
    "'headers': CASE WHEN cookie IS NULL THEN MAP {} ELSE MAP {cookie_header: cookie} END"
)
RESULT_JSON = with_(
    RUN,
    f"""
SELECT original_url, CASE WHEN error IS NULL THEN CAST(to_json({{{_JSON_HEAD}, 'http_status': http_status,
         'page_metadata': {{'title': page_title, 'description': page_description}}}}) AS VARCHAR)
       ELSE CAST(to_json({{{_JSON_HEAD}, 'error': error, 'attempts': {MAX_RETRIES}, 'attempted_urls':
         ['https://' || original_url, 'https://www.' || original_url, 'http://' || original_url,
          'https://' || original_url || '/']}}) AS VARCHAR) END AS value
FROM run
LEFT JOIN (SELECT page_id, list({{'category': category, 'patternId': pattern_id, 'match': match, 'source': source,
             'hubId': hub_id, 'confidence': confidence, 'context': CAST(NULL AS VARCHAR)}} ORDER BY rank_no) AS items
           FROM evidence GROUP BY page_id) USING (page_id)
LEFT JOIN (SELECT page_id, list(hub_id ORDER BY rank_no) AS id_list
           FROM (SELECT page_id, hub_id, min(rank_no) AS rank_no FROM evidence WHERE hub_id IS NOT NULL GROUP BY ALL)
           GROUP BY page_id) USING (page_id)""",
)

# --- run statistics ---------------------------------------------------------------------------------

_COUNTS = {
    "found_count": "hubspot_detected",
    "tracking_count": "tracking",
    "cms_count": "cms_hosting",
    "forms_count": "forms",
    "chat_count": "chat",
    "video_count": "video",
    "meetings_count": "meetings",
    "email_count": "email_tracking",
    **{f"{level}_count": f"confidence = '{level}'" for level in ("definitive", "strong", "moderate", "weak")},
}
STATS_OF_RUN = f"""counts AS (
  SELECT count(*) AS completed, count(*) FILTER (error IS NULL) AS success_count,
         count(*) FILTER (error IS NOT NULL) AS failure_count,
         {', '.join(f'count(*) FILTER (error IS NULL AND ({c})) AS {n}' for n, c in _COUNTS.items())},
         (SELECT count(DISTINCT hub_id) FROM evidence) AS unique_hub_ids, count(*) AS total_urls,
         CAST(epoch_us(max(fetched_at)) - epoch_us(min(fetched_at)) AS DOUBLE) / 1e6 AS elapsed_seconds
  FROM run),
stats AS (
  SELECT *, CAST(completed AS DOUBLE) / elapsed_seconds AS rate,
         CAST(total_urls - completed AS DOUBLE) / (CAST(completed AS DOUBLE) / elapsed_seconds) AS eta_seconds,
         CAST(completed AS DOUBLE) / total_urls * 100 AS percentage
  FROM counts)"""
STATS = RUN + ",\n" + STATS_OF_RUN

_CLOCK = (
    "CASE WHEN {s} >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', {s} // 3600, {s} % 3600 // 60, {s} % 60) "
    "ELSE format('{{:d}}:{{:02d}}', {s} // 60, {s} % 60) END"
)


def _clock(column: str) -> str:
    return _CLOCK.format(s=f"CAST(floor({column}) AS BIGINT)")


_HEAD = (
    "format('Progress: {}/{} ({:.1f}%) | Success: {} | Failed: {} | Rate: {:.1f} URL/s | Elapsed: {} | ETA: {}', "
    f"completed, total_urls, percentage, success_count, failure_count, rate, {_clock('elapsed_seconds')}, {_clock('eta_seconds')})"
)
_FOUND = "format('HubSpot Found: {}/{} ({:.1f}%)', found_count, success_count, CAST(found_count AS DOUBLE) / success_count * 100)"
STATUS = with_(
    STATS,
    f"""
SELECT {_HEAD} || chr(10) || {_FOUND} || format(' | Hub IDs: {{}} unique', unique_hub_ids) AS compact,
       {_HEAD} || chr(10) || {_FOUND}
         || format(' | Tracking: {{}} | CMS: {{}} | Forms: {{}} | Chat: {{}}', tracking_count, cms_count, forms_count, chat_count)
         || chr(10) || format('Confidence: Definitive: {{}} | Strong: {{}} | Moderate: {{}} | Weak: {{}} | Hub IDs: {{}} unique',
                   definitive_count, strong_count, moderate_count, weak_count, unique_hub_ids) AS detailed,
       CAST(to_json({{'progress': {{'completed': completed, 'total': total_urls, 'percentage': round(percentage, 2),
           'success': success_count, 'failed': failure_count}},
         'performance': {{'rate_urls_per_sec': round(rate, 2), 'elapsed_seconds': round(elapsed_seconds, 2),
           'eta_seconds': round(eta_seconds, 2)}},
         'hubspot_detection': {{'found': found_count, 'tracking': tracking_count, 'cms': cms_count, 'forms': forms_count,
           'chat': chat_count, 'video': video_count, 'meetings': meetings_count, 'email': email_count,
           'unique_hub_ids': unique_hub_ids}},
         'confidence': {{'definitive': definitive_count, 'strong': strong_count, 'moderate': moderate_count,
           'weak': weak_count}}}}) AS VARCHAR) AS json
FROM stats""",
)

_RUNNING = {"success_count": "error IS NULL", "failure_count": "error IS NOT NULL",
            **{n: f"error IS NULL AND ({c})" for n, c in _COUNTS.items()}}
SNAPSHOTS = with_(
    RUN + f""",
ordered AS (
  SELECT r.*, row_number() OVER w AS completed, count(*) OVER () AS total_urls,
         {', '.join(f'count(*) FILTER ({c}) OVER w AS {n}' for n, c in _RUNNING.items())}
  FROM run r WINDOW w AS (ORDER BY fetched_at, original_url ROWS UNBOUNDED PRECEDING)),
first_seen AS (SELECT hub_id, min(o.completed) AS seen_at FROM evidence JOIN ordered o USING (page_id)
               WHERE hub_id IS NOT NULL GROUP BY hub_id)""",
    f"""
SELECT 'r1' AS run_id, {ts('fetched_at')} AS fetched_at, total_urls, completed, {', '.join(_RUNNING)},
       (SELECT count(*) FROM first_seen WHERE seen_at <= completed) AS unique_hub_ids
FROM ordered WHERE completed % {SNAPSHOT_EVERY} = 0 OR completed = total_urls""",
)

# --- blocking ---------------------------------------------------------------------------------------

_RECENT = "list_sort(list_distinct(list_slice(doms, greatest(1, len(doms) - 4), len(doms))))"
BLOCK_WINDOWS = with_(
    ATTEMPTS + """,
framed AS (
  SELECT *, count(*) OVER w AS total_attempts, count(*) FILTER (is_blocking) OVER w AS blocking_failures,
         list(domain) FILTER (is_blocking) OVER w AS doms,
         count(*) FILTER (is_blocking) OVER (PARTITION BY egress ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS queued
  FROM attempts WINDOW w AS (PARTITION BY egress ORDER BY ts, attempt_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    f"""
SELECT egress, attempt_id, is_blocking, total_attempts, blocking_failures,
       CASE WHEN blocking_failures >= 5 THEN CAST(blocking_failures AS DOUBLE) / total_attempts END AS blocking_rate,
       CASE WHEN blocking_failures >= 5 THEN len({_RECENT}) END AS unique_domains,
       CASE WHEN blocking_failures >= 5 THEN array_to_string({_RECENT}, ',') END AS affected_domains,
       CASE WHEN blocking_failures >= 5 THEN least(queued, 50) END AS retry_queue_size,
       blocking_failures >= 5 AND len({_RECENT}) >= 2
         AND CAST(blocking_failures AS DOUBLE) / total_attempts >= 0.6 AS is_blocked
FROM framed""",
)

_LAST5 = "list_distinct(list_slice(doms, greatest(1, len(doms) - 4), len(doms)))"
BLOCK_ALERTS = with_(
    ATTEMPTS + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY egress ORDER BY ts, attempt_id) AS n,
               count(*) FILTER (is_blocking) OVER (PARTITION BY egress ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS queued
             FROM attempts),
walk AS (
  SELECT DISTINCT egress, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS win, CAST([] AS VARCHAR[]) AS seen, false AS fired
  FROM numbered
  UNION ALL
  SELECT egress, n, CASE WHEN fired THEN CAST([] AS VARCHAR[]) ELSE win END, win AS seen, fired
  FROM (SELECT egress, n, win, len(doms) >= 5 AND len({_LAST5}) >= 2 AND CAST(len(doms) AS DOUBLE) / len(win) >= 0.6 AS fired
        FROM (SELECT egress, n, win, list_filter(win, lambda x: x <> '') AS doms
              FROM (SELECT a.egress, a.n, list_slice(list_append(w.win, CASE WHEN a.is_blocking THEN a.domain ELSE '' END),
                             greatest(1, len(w.win) - 18), len(w.win) + 1) AS win
                    FROM walk w JOIN numbered a ON a.egress = w.egress AND a.n = w.n + 1)))),
alerts AS (SELECT egress, n, seen, list_filter(seen, lambda x: x <> '') AS doms FROM walk WHERE fired)""",
    f"""
SELECT run_id, egress, attempt_id, {ts('ts')} AS ts, len(doms) AS blocking_failures, len(seen) AS total_attempts,
       CAST(len(doms) AS DOUBLE) / len(seen) AS blocking_rate, len({_LAST5}) AS unique_domains,
       array_to_string(list_slice(list_sort({_LAST5}), 1, 5), ',') AS affected_domains, least(queued, 50) AS retry_queue_size
FROM alerts JOIN numbered USING (egress, n)""",
    recursive=True,
)

STALLS = f"""
SELECT run_id, {ts('ts')} AS last_update, {ts('next_ts')} AS next_update,
       CAST(epoch_us(next_ts) - epoch_us(ts) AS DOUBLE) / 1e6 AS stall_seconds
FROM (SELECT run_id, ts, lead(ts) OVER (PARTITION BY run_id ORDER BY ts) AS next_ts FROM attempts)
WHERE next_ts - ts > INTERVAL 600 SECOND"""


RETRY_QUEUE = """
SELECT egress, queue_pos, attempt_id, url
FROM (SELECT *, row_number() OVER (PARTITION BY egress ORDER BY ts DESC, attempt_id DESC) AS queue_pos
      FROM attempts WHERE is_blocking) WHERE queue_pos <= 50"""


def _fetch_error() -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in d.FETCH_ERRORS.items() if v)
    return f"CASE event_type {cases} END"


RETRY = f"""
WITH f AS (SELECT event_id AS attempt_id, CAST(event_id % 3 AS INTEGER) AS retry_no,
             lower('Failed to fetch https://d' || user_id || '.example.com/p: ' || {_fetch_error()}) AS error FROM events),
g AS (SELECT attempt_id, retry_no, CASE
        WHEN error IS NULL THEN 'success'
        WHEN regexp_matches(error, '429|too many requests') THEN 'rate_limited'
        WHEN regexp_matches(error, '403|forbidden') THEN 'forbidden'
        WHEN retry_no < {MAX_RETRIES - 1} AND regexp_matches(error, 'timeout|connection|network|dns|5') THEN 'retry'
        ELSE 'give_up' END AS decision FROM f)
SELECT attempt_id, retry_no, decision,
       CASE decision WHEN 'retry' THEN CAST(5 * 3 ** retry_no AS BIGINT) WHEN 'rate_limited' THEN 120 ELSE 0 END AS wait_seconds,
       CASE decision WHEN 'rate_limited' THEN 429 WHEN 'forbidden' THEN 403 END AS last_status
FROM g"""

_URL_PARTS = r"^([a-z]+)://([^/?#]*)([^?#]*)(.*)$"
VARIATIONS = with_(
    INPUTS + f""",
p AS (SELECT input_pos, {normalized('original_url')} AS url FROM inputs),
s AS (SELECT *, regexp_extract(url, '{_URL_PARTS}', 1) AS scheme, regexp_extract(url, '{_URL_PARTS}', 2) AS host,
        regexp_extract(url, '{_URL_PARTS}', 3) AS path, regexp_extract(url, '{_URL_PARTS}', 4) AS tail FROM p),
v AS (
  SELECT input_pos, url, 1 AS prio, scheme || '://' || CASE WHEN host LIKE 'www.%' THEN host[5:] ELSE 'www.' || host END || path || tail AS v FROM s
  UNION ALL SELECT input_pos, url, 2, CASE scheme WHEN 'https' THEN 'http' ELSE 'https' END || '://' || host || path || tail FROM s
  UNION ALL SELECT input_pos, url, 3, scheme || '://' || host || path || '/' || tail FROM s WHERE path NOT LIKE '%/'
  UNION ALL SELECT input_pos, url, 4, scheme || '://' || host || rtrim(path, '/') || tail FROM s WHERE path LIKE '%/' AND path <> '/')""",
    """
SELECT input_pos, url, row_number() OVER (PARTITION BY input_pos ORDER BY prio) AS variation_no, v AS variation_url
FROM v WHERE v <> url""",
)

_DOMAIN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_URLS = INPUTS + f", urls AS (SELECT input_pos, original_url, {normalized('original_url')} AS url FROM inputs)"

ORACLES = {
    "url_list_clean": with_(INPUTS, "SELECT input_pos, original_url FROM inputs"),
    "url_inputs_union": with_(
        INPUTS,
        "SELECT input_pos, original_url FROM inputs UNION ALL "
        + " UNION ALL ".join(f"SELECT {(1 << 62) + i}, {q(u)}" for i, u in enumerate(d.LITERAL_INPUTS)),
    ),
    "url_dedup": with_(
        INPUTS,
        "SELECT original_url, min(input_pos) AS input_pos, count(*) AS occurrences FROM inputs GROUP BY original_url",
    ),
    "resume_pending": with_(
        INPUTS, "SELECT input_pos, original_url FROM inputs WHERE original_url NOT IN (SELECT original_url FROM done)"
    ),
    "run_reconcile": with_(
        INPUTS,
        """
SELECT (SELECT count(*) FROM inputs) AS n_total, (SELECT count(DISTINCT original_url) FROM inputs) AS n_unique,
       (SELECT count(DISTINCT original_url) FROM inputs WHERE original_url IN (FROM done)) AS n_completed,
       (SELECT count(DISTINCT original_url) FROM inputs WHERE original_url IN (FROM failed)) AS n_failed,
       (SELECT count(DISTINCT original_url) FROM inputs WHERE original_url NOT IN (FROM done)) AS n_remaining,
       (SELECT count(*) FROM (FROM done INTERSECT FROM failed)) AS n_overlap,
       (SELECT count(*) - count(DISTINCT original_url) FROM done) AS n_log_duplicates,
       (SELECT count(*) FROM ((FROM done UNION FROM failed) EXCEPT SELECT original_url FROM inputs)) AS n_unknown""",
    ),
    "url_normalized": with_(_URLS, "SELECT input_pos, original_url, url FROM urls"),
    "url_domain": with_(_URLS, f"SELECT input_pos, url, {_DOMAIN} AS domain FROM urls"),
    "url_variations": VARIATIONS,
    "domain_waves": with_(
        _URLS,
        f"""
SELECT input_pos, url, domain, (row_number() OVER (PARTITION BY domain ORDER BY input_pos) - 1) // {MAX_PER_DOMAIN} + 1 AS wave
FROM (SELECT *, {_DOMAIN} AS domain FROM urls)""",
    ),
    "page_resources": with_(
        SITES + "," + _resources("resources", "script|link|iframe|a"), "SELECT page_id, pos, url FROM resources"
    ),
    "page_metadata": with_(
        SITES, f"SELECT page_id, {_TITLE} AS title, CAST(NULL AS VARCHAR) AS description FROM sites"
    ),
    "final_url_rule": with_(
        SITES,
        "SELECT page_id, original_url, http_status, "
        "CASE WHEN http_status >= 400 THEN original_url ELSE requested_url END AS final_url FROM sites",
    ),
    "network_log_flat": with_(
        NETWORK,
        """
SELECT page_id, url, 'GET' AS method, CASE WHEN page_id % 4 > 0 THEN 200 END AS status, k AS cookie_no,
       CASE WHEN k IS NOT NULL THEN 'hubspotutk=a; Path=/' END AS cookie
FROM network LEFT JOIN range(1, 3) AS t(k) ON k <= page_id % 3""",
    ),
    "html_evidence": with_(
        SITES + "," + HTML_EV,
        f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord, sub) AS seq, {_EV_COLUMNS} FROM html_ev",
    ),
    "network_evidence": with_(
        NETWORK + "," + _url_ev("url_ev", "network"), f"SELECT page_id, pos, rule_pos, {_EV_COLUMNS} FROM url_ev"
    ),
    "cookie_evidence": with_(SITES + "," + COOKIE_EV, f"SELECT page_id, seq, {_EV_COLUMNS} FROM cookie_ev"),
    "evidence_all": with_(RENDERED, f"SELECT page_id, {_EV_COLUMNS} FROM evidence"),
    "catalog_theta_join": with_(
        SITES + f", sig(pattern_id, regex) AS (VALUES {', '.join(f'({q(p)}, {rx})' for p, rx in RX.items())})",
        "SELECT page_id, pattern_id FROM sites JOIN sig ON regexp_matches(html, regex, 'i')",
    ),
    "catalog_index_join": with_(
        SITES + f""", sig(pattern_id, regex) AS (VALUES {', '.join(f'({q(p)}, {rx})' for p, rx in RX.items())}),
labels AS (SELECT DISTINCT regexp_extract(url, '://([a-z]+)[.]', 1) AS label FROM pages),
every AS (SELECT * FROM sig UNION ALL SELECT 'label_' || label, '[ >]' || label || '[a-z]{{2}}[ <]' FROM labels WHERE label <> '')""",
        "SELECT page_id, pattern_id FROM sites JOIN every ON regexp_matches(html, regex, 'i')",
    ),
    "catalog_profile": with_(
        SITES + f", sig(pattern_id, regex) AS (VALUES {', '.join(f'({q(p)}, {rx})' for p, rx in RX.items())})",
        "SELECT pattern_id, length(regex) AS regex_length, count(page_id) AS n_pages "
        "FROM sig LEFT JOIN sites ON regexp_matches(html, regex, 'i') GROUP BY ALL",
    ),
    "evidence_by_category": with_(
        RENDERED,
        "SELECT category, pattern_id, count(*) AS n_evidence, count(DISTINCT page_id) AS n_pages FROM evidence GROUP BY ALL",
    ),
    "prefilter_parity": with_(
        SITES + "," + HTML_EV,
        "SELECT page_id, count(e.page_id) AS n_plain, count(e.page_id) AS n_guarded, true AS same "
        "FROM sites LEFT JOIN html_ev e USING (page_id) GROUP BY page_id",
    ),
    "detection_result": DETECTION,
    "summary_flags": with_(
        RENDERED + "," + _summary(), f"SELECT page_id, {FLAG_NAMES}, evidence_count FROM summary"
    ),
    "confidence_level": with_(RENDERED + "," + _summary(), "SELECT page_id, confidence FROM summary"),
    "detected_flag": with_(RENDERED + "," + _summary(), "SELECT page_id, hubspot_detected FROM summary"),
    "hub_ids_by_page": with_(RENDERED + "," + _summary(), "SELECT page_id, hub_ids FROM ids"),
    "multi_portal_pages": with_(STATIC + "," + _summary(), "SELECT page_id, hub_ids FROM ids WHERE hub_id_count > 1"),
    "result_flat": with_(
        RUN,
        f"""
SELECT original_url, final_url, {_ISO} AS "timestamp", hubspot_detected, tracking, cms_hosting, confidence, forms, chat,
       ctas_legacy, meetings, video, email_tracking, hub_ids, hub_id_count, evidence_count,
       coalesce(CAST(http_status AS VARCHAR), '') AS http_status, coalesce(page_title, '') AS page_title,
       coalesce(page_description, '') AS page_description
FROM run""",
    ),
    "result_json": RESULT_JSON,
    "failure_results": with_(
        ATTEMPTS + "," + FAILURES,
        f"""
SELECT original_url, final_url, hubspot_detected, confidence, error, {MAX_RETRIES} AS attempts,
       'https://' || original_url || ',https://www.' || original_url || ',http://' || original_url || ',https://'
         || original_url || '/' AS attempted_urls, {ts('fetched_at')} AS fetched_at
FROM failures""",
    ),
    "completed_urls": with_(SITES, "SELECT original_url FROM sites"),
    "result_violations": with_(
        STATIC,
        """
SELECT page_id, 'final_url' AS field, 'missing' AS reason, CAST(NULL AS INTEGER) AS evidence_no FROM sites WHERE page_id % 17 = 3
UNION ALL SELECT page_id, 'confidence', 'not allowed', NULL FROM sites WHERE page_id % 13 = 5
UNION ALL SELECT DISTINCT page_id, 'evidence.source', 'not allowed', 1 FROM evidence WHERE page_id % 7 = 2
UNION ALL SELECT DISTINCT page_id, 'evidence.category', 'missing', 1 FROM evidence WHERE page_id % 11 = 4 AND page_id % 7 <> 2""",
    ),
    "json_violations": with_(
        STATIC + """,
ok AS (SELECT * FROM sites WHERE page_id % 13 <> 5),
items AS (SELECT page_id, unnest(range(count(*))) AS i FROM evidence GROUP BY page_id)""",
        """
SELECT page_id, '' AS field, 'not JSON' AS reason FROM sites WHERE page_id % 13 = 5
UNION ALL SELECT page_id, 'summary.tracking', 'missing' FROM ok WHERE page_id % 7 = 1
UNION ALL SELECT page_id, 'summary.tracked', 'not expected' FROM ok WHERE page_id % 7 = 1
UNION ALL SELECT page_id, 'hubIds[0]', 'wrong type' FROM ok WHERE page_id % 5 = 2
UNION ALL SELECT page_id, 'summary.features.forms', 'wrong type' FROM ok WHERE page_id % 9 = 4
UNION ALL SELECT page_id, 'summary.features.polls', 'not expected' FROM ok WHERE page_id % 9 = 4
UNION ALL SELECT page_id, 'evidence[' || i || '].patternId', 'missing' FROM ok JOIN items USING (page_id) WHERE page_id % 11 = 6
UNION ALL SELECT page_id, 'evidence[' || i || '].pattern', 'not expected' FROM ok JOIN items USING (page_id) WHERE page_id % 11 = 6
UNION ALL SELECT page_id, 'page_metadata.title', 'wrong type' FROM ok WHERE page_id % 8 = 3
UNION ALL SELECT page_id, 'page_metadata.heading', 'not expected' FROM ok WHERE page_id % 8 = 3
UNION ALL SELECT page_id, 'original_url', 'bad format' FROM ok WHERE NOT regexp_matches(original_url, '^[A-Za-z][A-Za-z0-9+.-]*:')
UNION ALL SELECT page_id, 'final_url', 'bad format' FROM ok
WHERE http_status >= 400 AND NOT regexp_matches(original_url, '^[A-Za-z][A-Za-z0-9+.-]*:')""",
    ),
    "result_url_variation": with_(
        SITES,
        """
SELECT original_url, CASE WHEN page_id % 6 = 0 THEN CAST(to_json({'original_url': original_url,
       'working_url': regexp_replace(requested_url, '^https:', 'http:'), 'variation_type': 'auto'}) AS VARCHAR) END AS url_variation
FROM sites""",
    ),
    "run_statistics": with_(STATS, "SELECT * FROM stats"),
    "stream_outputs": with_(
        SITES,
        """
SELECT original_url, count(*) AS jsonl, count(*) FILTER (page_id % 10 = 9) AS failures, count(*) FILTER (page_id % 10 <> 9) AS completed
FROM sites GROUP BY original_url""",
    ),
    "stream_statistics": with_(
        ",".join([STATIC, _summary(), RESULTS]) + f""",
run AS (SELECT * EXCLUDE (error), CASE WHEN page_id % 10 = 9 THEN 'no answer' END AS error FROM results),
{STATS_OF_RUN.replace('FROM evidence', 'FROM evidence WHERE page_id % 10 <> 9')}""",
        "SELECT * FROM stats",
    ),
    "run_status_json": STATUS,
    "confidence_distribution": with_(
        RUN, "SELECT confidence, count(*) AS n_results FROM run WHERE error IS NULL GROUP BY confidence"
    ),
    "hub_id_usage": with_(
        STATIC, "SELECT hub_id, count(DISTINCT page_id) AS n_pages FROM evidence WHERE hub_id IS NOT NULL GROUP BY hub_id"
    ),
    "progress_snapshots": SNAPSHOTS,
    "progress_by_window": with_(
        ATTEMPTS + """,
w AS (SELECT run_id, date_trunc('hour', ts) AS start, count(*) FILTER (success) AS completed,
        count(*) FILTER (NOT success) AS failed FROM attempts GROUP BY ALL),
c AS (SELECT *, sum(completed) OVER o AS total_completed, sum(failed) OVER o AS total_failed,
        sum(completed + failed) OVER (PARTITION BY run_id) AS total_urls, CAST(completed AS DOUBLE) / 3600.0::DOUBLE AS rate
      FROM w WINDOW o AS (PARTITION BY run_id ORDER BY start))""",
        f"""
SELECT run_id, {ts('start')} AS window_start, completed, failed, CAST(total_completed AS BIGINT) AS total_completed,
       CAST(total_failed AS BIGINT) AS total_failed, CAST(total_urls AS BIGINT) AS total_urls, rate,
       CAST(total_completed + total_failed AS BIGINT) AS total_processed,
       CAST(total_urls - total_completed AS BIGINT) AS remaining,
       CAST(total_completed AS DOUBLE) / CAST(total_urls AS DOUBLE) * 100 AS progress_pct,
       CASE WHEN rate > 0 THEN CAST(total_urls - total_completed AS DOUBLE) / rate END AS eta_seconds
FROM c""",
    ),
    "stall_gaps": with_(ATTEMPTS, STALLS),
    "retry_plan": RETRY.strip(),
    "resolved_url": with_(
        ATTEMPTS,
        """
SELECT original_url, url AS working_url, variation_no, CASE WHEN variation_no > 0 THEN 'auto' END AS variation_type
FROM (SELECT DISTINCT original_url FROM attempts) LEFT JOIN (
  SELECT original_url, url, variation_no FROM (
    SELECT *, row_number() OVER (PARTITION BY original_url ORDER BY variation_no, retry_no, attempt_id) AS nth
    FROM attempts WHERE success) WHERE nth = 1) USING (original_url)""",
    ),
    "attempt_class": with_(
        ATTEMPTS,
        """
SELECT attempt_id, domain, NOT success AND (coalesce(status_code IN (403, 429), false) OR coalesce(regexp_matches(lower(error),
         'connection reset|tls|ssl|clientconnectorerror|connectionreseterror'), false)) AS is_blocking
FROM attempts""",
    ),
    "block_windows": BLOCK_WINDOWS,
    "block_alerts": BLOCK_ALERTS,
    "retry_queue": with_(ATTEMPTS, RETRY_QUEUE),
    "stream_retry_queue": with_(ATTEMPTS, RETRY_QUEUE),
    "stream_detection": DETECTION,
    "stream_block_alerts": BLOCK_ALERTS,
    "stream_dedup": with_(ATTEMPTS, "SELECT DISTINCT original_url FROM attempts"),
    "stream_progress": with_(
        ATTEMPTS,
        f"""
SELECT run_id, {ts("date_trunc('hour', ts)")} AS window_start, count(*) FILTER (success) AS completed,
       count(*) FILTER (NOT success) AS failed
FROM attempts GROUP BY ALL""",
    ),
    "stream_stalls": with_(ATTEMPTS, STALLS),
    "stall_open": with_(
        ATTEMPTS,
        f"""
SELECT run_id, {ts('max(ts)')} AS last_update, {ts("max(ts) + INTERVAL 1 HOUR")} AS next_update, 3600.0::DOUBLE AS stall_seconds
FROM attempts GROUP BY run_id""",
    ),
}
