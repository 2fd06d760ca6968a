"""Result sinks. Every sink appends, so a resumed run adds to what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitemarks.operators.results import completed, failures, flat_results, json_results


def write_results_jsonl(results: DataFrame, path: str, pretty: bool = False, mode: str = "append") -> None:
    """One JSON result per line (``pretty`` spreads each over several lines)."""
    json_results(results, pretty).select("value").write.mode(mode).text(path)


def write_results_csv(results: DataFrame, path: str, mode: str = "append") -> None:
    """The 19 flat columns with a header; empty text stays empty and quotes are doubled."""
    writer = flat_results(results).write.mode(mode).option("header", True).option("emptyValue", "")
    writer.option("quote", '"').option("escape", '"').csv(path)


def write_failures(results: DataFrame, path: str, mode: str = "append") -> None:
    """The failed results as JSON lines, next to (not instead of) the main output."""
    write_results_jsonl(failures(results), path, mode=mode)


def write_completed(results: DataFrame, path: str, mode: str = "append") -> None:
    """Original URLs of the successes: the log a resumed run reads."""
    completed(results).select("original_url").write.mode(mode).text(path)
