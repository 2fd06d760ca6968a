"""URL list files: one URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.functions.html import strip_sql
from sitemarks.operators.ordered import with_row_number
from sitemarks.operators.url_prep import clean_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``input_pos, line`` of text files, numbered in file order over any number of splits."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_in_split"),
        F.col("value").alias("line"),
        F.lit(0).alias("_all"),
    )
    order = ["_file", "_block", "_in_split"]
    return with_row_number(lines, ["_all"], order, "input_pos").select("input_pos", "line")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``input_pos, original_url``: trimmed lines without blanks and ``#`` comments."""
    return clean_lines(read_lines(spark, path))


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """The completed-URL log: distinct handling is left to the anti join."""
    return spark.read.text(path).selectExpr(f"{strip_sql('value')} AS original_url").filter("original_url <> ''")
