"""Result validation: every broken rule becomes a row; nothing is raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.operators.json_schema import json_problems
from sitemarks.operators.results import JSON_FEATURES
from sitemarks.sources.catalog import CONFIDENCE_LEVELS

#: What a result may hold.
CATEGORIES = ["tracking", "forms", "chat", "ctas", "meetings", "cms", "files", "video", "email", "cookies", "headers"]
SOURCES = ["html", "script", "url", "cookie", "header", "har", "other"]
LEVELS = list(CONFIDENCE_LEVELS)
REQUIRED = ["original_url", "final_url", "fetched_at", "tracking", "cms_hosting", "confidence", "evidence"]
EVIDENCE_REQUIRED = ["category", "pattern_id", "match", "source", "confidence"]


def _object(properties: dict, required: list[str] = (), closed: bool = False) -> dict:
    schema = {"type": "object", "properties": properties, "required": list(required)}
    return {**schema, "additionalProperties": False} if closed else schema


_TEXT, _FLAG, _URL = {"type": "string"}, {"type": "boolean"}, {"type": "string", "format": "uri"}
_TEXT_OR_NULL = {"type": ["string", "null"]}
_EVIDENCE = {
    "category": {"type": "string", "enum": CATEGORIES},
    "patternId": _TEXT,
    "match": _TEXT,
    "source": {"type": "string", "enum": SOURCES},
    "hubId": {"type": ["integer", "null"]},
    "confidence": {"type": "string", "enum": LEVELS},
    "context": _TEXT_OR_NULL,  # evidence without a context is exported with a null
}
_SUMMARY = {
    "tracking": _FLAG,
    "cmsHosting": _FLAG,
    "features": _object({name: _FLAG for name in JSON_FEATURES}, closed=True),
    "confidence": {"type": "string", "enum": LEVELS},
}
_VARIATION = {"original_url": _URL, "working_url": _URL, "variation_type": {"type": "string", "enum": ["auto"]}}

#: What an exported result must look like, as a JSON Schema.
RESULT_SCHEMA = {
    **_object(
        {
            "original_url": _URL,
            "final_url": _URL,
            "timestamp": {"type": "string", "format": "date-time"},
            "hubspot_detected": _FLAG,
            "hubIds": {"type": "array", "items": {"type": "integer"}},
            "summary": _object(_SUMMARY, list(_SUMMARY), closed=True),
            "evidence": {"type": "array", "items": {"$ref": "#/$defs/Evidence"}},
            "headers": {"type": "object", "additionalProperties": _TEXT},
            "url_variation": _object(_VARIATION, list(_VARIATION), closed=True),
            "http_status": {"type": "integer"},
            "page_metadata": _object({"title": _TEXT_OR_NULL, "description": _TEXT_OR_NULL}, closed=True),
        },
        ["original_url", "final_url", "timestamp", "summary", "evidence"],
    ),
    "$defs": {"Evidence": _object(_EVIDENCE, ["category", "patternId", "match", "source", "confidence"], closed=True)},
}


def _outside(value: Column, allowed: list[str]) -> Column:
    return value.isNotNull() & ~value.isin(allowed)


def result_violations(results: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, field, reason, evidence_no``: missing required values and values outside their lists.

    ``evidence_no`` is the 1-based position for rules on evidence, else NULL. An
    evidence without ``context`` is valid.
    """
    none = F.lit(None).cast("int")

    def broken(field: str, reason: str, position: Column = none) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), position.alias("evidence_no"))

    checks = [F.when(F.col(name).isNull(), broken(name, "missing")) for name in REQUIRED]
    checks.append(F.when(_outside(F.col("confidence"), LEVELS), broken("confidence", "not allowed")))

    def in_evidence(e: Column, i: Column) -> Column:
        position = (i + 1).cast("int")
        found = [
            F.when(e[name].isNull(), broken(f"evidence.{name}", "missing", position)) for name in EVIDENCE_REQUIRED
        ]
        for name, allowed in (("category", CATEGORIES), ("source", SOURCES), ("confidence", LEVELS)):
            found.append(F.when(_outside(e[name], allowed), broken(f"evidence.{name}", "not allowed", position)))
        return F.array_compact(F.array(*found))

    evidence = F.flatten(F.transform(F.coalesce("evidence", F.expr("array()").cast(_evidence_type(results))), in_evidence))
    every = F.concat(F.array_compact(F.array(*checks)), evidence)
    return results.select(key, F.explode(every).alias("v")).select(key, "v.*")


def _evidence_type(results: DataFrame):
    return results.schema["evidence"].dataType


def json_violations(lines: DataFrame, column: str = "value", key: str = "original_url", formats: bool = False) -> DataFrame:
    """``key, field, reason`` for exported JSON text that is unreadable or breaks ``RESULT_SCHEMA``.

    ``formats`` asserts URIs and times as well. An input URL without a scheme is no URI, so it is off by default.
    """
    return json_problems(lines, RESULT_SCHEMA, key, column, formats)
