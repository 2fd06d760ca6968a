"""Durations as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_time(seconds: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from one hour on."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", minutes, rest)
    )


def spoken_time(seconds: Column) -> Column:
    """``5s``, ``2m 5s`` or ``1h 2m``."""
    s = F.floor(seconds).cast("bigint")
    return (
        F.when(seconds < 60, F.format_string("%ds", s))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def utc_text(ts: Column) -> Column:
    """ISO 8601 in UTC with a ``Z``, whatever the session's time zone; microseconds only when there are any."""
    ts = F.to_utc_timestamp(ts, F.current_timezone())
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == ".000000", "").otherwise(micros), F.lit("Z")
    )
