"""Network logs: captured requests as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.schemas import NETWORK_EVENT


def read_network_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NETWORK_EVENT).json(path)


def parse_network_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text next to other columns: the event's fields replace the text."""
    return lines.select("*", F.from_json(column, NETWORK_EVENT).alias("_event")).select("*", "_event.*").drop(
        column, "_event"
    )


def flatten_cookies(events: DataFrame) -> DataFrame:
    """One row per event and cookie (events without cookies keep one row, ``cookie_no`` NULL)."""
    kept = [c for c in events.columns if c not in ("setCookies", "headers", "body")]
    return events.select(*kept, F.posexplode_outer("setCookies").alias("_pos", "cookie")).select(
        *kept, (F.col("_pos") + 1).alias("cookie_no"), "cookie"
    )
