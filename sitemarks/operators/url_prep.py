"""Preparing URL lists: cleaning, merging, dedup, resume, variations, fetch waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemarks.functions.html import strip_sql
from sitemarks.functions.urls import DEFAULT_MAX_VARIATIONS, url_domain, url_variations
from sitemarks.operators.ordered import with_row_number

#: Positions of URLs given as literals start here: after every line of any file.
LITERAL_BASE = 1 << 62


def clean_lines(lines: DataFrame) -> DataFrame:
    """``input_pos, line`` to ``input_pos, original_url``: trimmed, without blanks and ``#`` comments."""
    return lines.selectExpr("input_pos", f"{strip_sql('line')} AS original_url").filter(
        (F.col("original_url") != "") & ~F.col("original_url").startswith("#")
    )


def union_inputs(file_urls: DataFrame, literals: list[str]) -> DataFrame:
    """URLs of a file followed by URLs given as literals (taken as they are)."""
    rows = [(LITERAL_BASE + i, u) for i, u in enumerate(literals)]
    extra = file_urls.sparkSession.createDataFrame(rows, "input_pos bigint, original_url string")
    return file_urls.select("input_pos", "original_url").unionByName(extra)


def dedup_urls(urls: DataFrame) -> DataFrame:
    """One row per exact input string at its first position, with how often it occurred."""
    return urls.groupBy("original_url").agg(
        F.min("input_pos").alias("input_pos"), F.count("*").alias("occurrences")
    )


def duplicates_removed(urls: DataFrame) -> DataFrame:
    """One row: inputs, unique inputs, duplicates removed."""
    return dedup_urls(urls).agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n_inputs"),
        F.count("*").alias("n_unique"),
        F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("n_removed"),
    )


def pending_urls(urls: DataFrame, completed: DataFrame) -> DataFrame:
    """Inputs that are not completed yet; repeated inputs stay repeated.

    The completed side is made distinct first, so a URL logged many times is one
    row. Spark broadcasts it only below its own size threshold.
    """
    done = completed.select("original_url").distinct()
    return urls.join(done, "original_url", "left_anti")


def variations(urls: DataFrame, max_variations: int = DEFAULT_MAX_VARIATIONS, column: str = "url") -> DataFrame:
    """One row per variation to try, numbered from 1 in priority order."""
    tried = url_variations(column, max_variations)
    return urls.select("*", F.posexplode(tried).alias("_pos", "variation_url")).withColumn(
        "variation_no", F.col("_pos") + 1
    ).drop("_pos")


def domain_waves(urls: DataFrame, max_per_domain: int, column: str = "url", position: str = "input_pos") -> DataFrame:
    """Number the fetch waves so that no wave holds more than ``max_per_domain`` URLs of a domain.

    Rows are numbered across slices of a domain, so a domain with a third of all
    URLs is not sorted by one task.
    """
    with_domain = urls.withColumn("domain", url_domain(column))
    numbered = with_row_number(with_domain, ["domain"], [position], "_no")
    return numbered.withColumn("wave", F.floor((F.col("_no") - 1) / max_per_domain) + 1).drop("_no")
