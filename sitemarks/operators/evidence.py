"""Evidence: what the signatures find on pages, network URLs and cookies.

Two forms with the same result:

* array form - one row per page carrying its evidence array. Page-local, so it
  runs in the scan stage without any shuffle. Used for the result table.
* long form - one row per evidence. Used when network requests come from a log
  table of their own. Its dedup is a grouped minimum with map-side combine, so a
  page that owns a third of the log is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemarks.functions.html import page_resources, strip_sql
from sitemarks.functions.regexes import LiteralSearch, folded, text
from sitemarks.functions.signatures import (
    HtmlRules,
    any_url_literal,
    cookie_evidence_array,
    first_wins,
    is_match,
    network_evidence_array,
    set_cookie_values,
    url_evidence,
)
from sitemarks.sources.catalog import CONFIDENCE_LEVELS, Catalog, load_catalog

KEY = ("category", "pattern_id", "source", "match")
#: Sequence numbers of the long form: surface, then position on it, then rule or match number.
SURFACE_STEP = 1 << 56
POSITION_STEP = 1 << 20


def with_html_evidence(
    pages: DataFrame, catalog: Catalog | None = None, out: str = "html_evidence", prefilter: bool = True
) -> DataFrame:
    """Add the evidence array of ``html``. ``prefilter`` only decides the speed, never the rows."""
    catalog = catalog or load_catalog()
    rules = HtmlRules(catalog)
    kept = [c for c in pages.columns]
    df = pages.withColumn("_html", F.coalesce("html", F.lit("")))
    if prefilter:
        df, known = _searched(df, catalog)
        df = df.selectExpr(*kept, "_html", *rules.matches("_html", "_folded", known))
    else:
        df = df.selectExpr(*kept, "_html", *rules.matches("_html", None))
    return computed_once(df.select(*kept, F.expr(rules.evidence("_html")).alias(out)), out)


def _searched(df: DataFrame, catalog: Catalog) -> tuple[DataFrame, dict[str, str]]:
    """Add the folded ``_html`` and its stem searches; returns the condition per literal too."""
    search = LiteralSearch(catalog.first_literals())
    df = df.withColumn("_folded", F.expr(folded("_html")))
    return df.selectExpr("*", *search.columns("_folded")), search.known("_folded")


def with_network(pages: DataFrame, out: str = "network") -> DataFrame:
    """Network URLs per page: the captured list where there is one, else the page's own resources."""
    links = page_resources("coalesce(html, '')", "coalesce(requested_url, '')")
    if "network" in pages.columns:
        links = F.coalesce("network", links)
    return pages.withColumn(out, links)


def with_evidence(pages: DataFrame, catalog: Catalog | None = None, prefilter: bool = True) -> DataFrame:
    """Add the complete, ordered, deduplicated ``evidence`` array of each page (no shuffle).

    Order: HTML rules, network URLs, then cookies. Cookies are appended after
    the dedup and are never deduplicated themselves.
    """
    catalog = catalog or load_catalog()
    kept = [c for c in pages.columns if c != "network"]
    df = with_html_evidence(with_network(pages), catalog, "_html_ev", prefilter)
    found = f"concat(_html_ev, {network_evidence_array(catalog, 'network', prefilter)}) AS _found"
    cookies = f"{cookie_evidence_array(catalog, page_cookies(pages))} AS _cookies"
    df = df.selectExpr(*kept, found, cookies)
    return computed_once(df.selectExpr(*kept, f"concat({first_wins('_found')}, _cookies) AS evidence"), "evidence")


def computed_once(df: DataFrame, column: str) -> DataFrame:
    """Keep the optimizer from repeating a costly column.

    A filter on something derived from the column (also the one Spark infers
    below an explode) would be pushed under its projection with the whole
    expression inlined, so every regex would run once for the filter and once
    more for the output. Predicates on generator output are not pushed, and a
    one-element explode costs next to nothing.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(column)).alias(column))


def page_cookies(pages: DataFrame) -> str:
    return set_cookie_values("headers", "set_cookies" if "set_cookies" in pages.columns else None)


def explode_evidence(df: DataFrame, array: str = "evidence", *keys: str) -> DataFrame:
    """One row per evidence with its 1-based position ``seq`` in the page's list."""
    keys = keys or ("page_id",)
    return df.select(*keys, F.posexplode(array).alias("_pos", "_e")).select(
        *keys, (F.col("_pos") + 1).alias("seq"), "_e.*"
    )


def html_evidence(pages: DataFrame, catalog: Catalog | None = None, prefilter: bool = True) -> DataFrame:
    """Long-form evidence of the HTML rules (before any dedup)."""
    return explode_evidence(with_html_evidence(pages, catalog, prefilter=prefilter), "html_evidence")


def network_evidence(network: DataFrame, catalog: Catalog | None = None, prefilter: bool = True) -> DataFrame:
    """Long-form evidence of a network log ``page_id, pos, url`` (before any dedup). No shuffle."""
    catalog = catalog or load_catalog()
    df = network.selectExpr("page_id", "pos", f"{strip_sql('url')} AS url").filter("url <> ''")
    if prefilter:
        df = df.withColumn("_folded", F.expr(folded("url"))).filter(any_url_literal(catalog, "_folded"))
    found = F.expr(url_evidence(catalog, "url", "_folded" if prefilter else None))
    return df.select("page_id", "pos", F.posexplode(found).alias("_rule", "_e")).select(
        "page_id", "pos", (F.col("_rule") + 1).alias("rule_pos"), "_e.*"
    )


def cookie_evidence(pages: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Long-form evidence of the response cookies."""
    found = cookie_evidence_array(catalog or load_catalog(), page_cookies(pages))
    return explode_evidence(computed_once(pages.selectExpr("page_id", f"{found} AS evidence"), "evidence"))


def evidence_rows(pages: DataFrame, network: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Complete long-form evidence of pages whose network requests are a table of their own.

    ``seq`` orders the evidence of a page but is not consecutive.
    """
    catalog = catalog or load_catalog()
    on_page = html_evidence(pages, catalog)
    on_net = network_evidence(network, catalog)
    cookies = cookie_evidence(pages, catalog)
    on_page = on_page.withColumn("seq", F.col("seq").cast("bigint"))
    on_net = on_net.withColumn(
        "seq", F.lit(SURFACE_STEP) + F.col("pos").cast("bigint") * POSITION_STEP + F.col("rule_pos")
    ).drop("pos", "rule_pos")
    cookies = cookies.withColumn("seq", F.lit(2 * SURFACE_STEP) + F.col("seq"))
    return dedup_evidence(on_page.unionByName(on_net)).unionByName(cookies.select(on_page.columns))


def dedup_evidence(rows: DataFrame) -> DataFrame:
    """Keep the first evidence (lowest ``seq``) per page and key.

    What is aggregated has a fixed width (the confidence as its number), which
    lets Spark hash instead of sort before and after the shuffle.
    """
    levels = F.array(*map(F.lit, CONFIDENCE_LEVELS))
    coded = rows.withColumn("_level", F.array_position(levels, F.col("confidence")).cast("int"))
    best = coded.groupBy("page_id", *KEY).agg(
        F.min("seq").alias("seq"), F.min_by("hub_id", "seq").alias("hub_id"), F.min_by("_level", "seq").alias("_level")
    )
    return best.select(
        "page_id", "seq", "category", "pattern_id", "match", "source", "hub_id",
        F.get(levels, F.col("_level") - 1).alias("confidence"), F.lit(None).cast("string").alias("context"),
    )


def catalog_matches(pages: DataFrame, catalog: Catalog, prefilter: bool = True) -> DataFrame:
    """Every page and catalogue pattern that match, without rules: for ad-hoc catalogues.

    The page-by-pattern condition is unrolled over the size-checked catalogue,
    so it stays a projection over the scan instead of a nested-loop join.
    """
    df = pages.select("page_id", F.coalesce("html", F.lit("")).alias("_html"))
    known = None
    if prefilter:
        df, known = _searched(df, catalog)
    matched = [
        f"CASE WHEN {is_match(catalog, p, '_html', '_folded' if prefilter else None, known)} THEN {text(p)} END"
        for p in catalog.patterns
    ]
    return df.selectExpr("page_id", f"explode(array_compact(array({', '.join(matched)}))) AS pattern_id")


def catalog_profile(pages: DataFrame, catalog: Catalog) -> DataFrame:
    """Per catalogue pattern: its regex length and on how many pages it matches (0 included)."""
    matched = catalog_matches(pages, catalog).groupBy("pattern_id").agg(F.count("*").alias("n_pages"))
    base = matched.sparkSession.createDataFrame(
        [(p, len(rx)) for p, rx in catalog.patterns.items()], "pattern_id string, regex_length int"
    )
    return base.join(matched, "pattern_id", "left").select(
        "pattern_id", "regex_length", F.coalesce("n_pages", F.lit(0)).alias("n_pages")
    )
