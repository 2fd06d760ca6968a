"""The signature catalogue: patterns and ordered rules, held as data.

A catalogue is small by nature (tens of rows). It is read on the driver because
its regexes become literals of the query plan; its size is checked on load, so a
wrong path cannot pull a large file in.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.functions.regexes import check_regex, required_literals

MATCH_CHARS = 300
MAX_PATTERNS = 2_000
MAX_BYTES = 4 << 20
SURFACES = ("html", "url", "cookie")
#: Confidence levels, from sure to unsure.
CONFIDENCE_LEVELS = ("definitive", "strong", "moderate", "weak")
_DEFAULT = ("sitemarks.sources", "signatures.json")


@dataclass(frozen=True)
class Rule:
    """One ordered rule: which pattern, on which surface, and what a match means."""

    pattern: str
    category: str
    confidence: str
    emit_id: str | None = None
    id_group: int | None = None
    id_fallback: bool = False
    match_all: bool = False
    requires: str | None = None
    unless: str | None = None
    upgrade_if: str | None = None
    upgrade_match: str | None = None
    upgrade_to: str | None = None

    @property
    def pattern_id(self) -> str:
        return self.emit_id or self.pattern


@dataclass(frozen=True)
class Catalog:
    patterns: dict[str, str]
    rules: dict[str, tuple[Rule, ...]]
    id_fallback: str | None = None
    version: str | None = None
    #: Characters of a match that evidence keeps and is told apart by; None keeps and compares all of it.
    match_chars: int | None = MATCH_CHARS

    def first_literals(self) -> list[str]:
        """The literals searched for first, over all patterns."""
        return [x for p in self.patterns for clause in self.literals(p)[:1] for x in clause]

    def literals(self, pattern: str) -> list[tuple[str, ...]]:
        return required_literals(self.patterns[pattern])


def parse_catalog(text: str) -> Catalog:
    raw = json.loads(text)
    patterns = dict(raw["patterns"])
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"catalogue holds {len(patterns)} patterns, more than {MAX_PATTERNS}")
    for regex in patterns.values():
        check_regex(regex)
    known = {f.name for f in fields(Rule)}
    rules: dict[str, tuple[Rule, ...]] = {}
    for surface, entries in raw.get("rules", {}).items():
        if surface not in SURFACES:
            raise ValueError(f"unknown surface {surface!r}")
        rules[surface] = tuple(Rule(**{k: v for k, v in e.items() if k in known}) for e in entries)
        for rule in rules[surface]:
            if not {rule.confidence, rule.upgrade_to or rule.confidence} <= set(CONFIDENCE_LEVELS):
                raise ValueError(f"unknown confidence in the rule for {rule.pattern!r}")
            if rule.match_all and rule.id_group:
                raise ValueError(f"a rule that takes every match carries no id: {rule.pattern!r}")
            for name in (rule.pattern, rule.requires, rule.unless, rule.upgrade_if):
                if name is not None and name not in patterns:
                    raise ValueError(f"rule names unknown pattern {name!r}")
    return Catalog(patterns, rules, raw.get("id_fallback"), raw.get("version"), raw.get("match_chars", MATCH_CHARS))


def load_catalog(spark: SparkSession | None = None, path: str | None = None) -> Catalog:
    """The built-in catalogue, or one read by Spark from any file system it can reach."""
    if path is None:
        return parse_catalog(resources.files(_DEFAULT[0]).joinpath(_DEFAULT[1]).read_text("utf-8"))
    files = spark.read.format("binaryFile").load(path).select("length").limit(2).collect()
    if len(files) != 1 or files[0].length > MAX_BYTES:
        raise ValueError(f"expected one catalogue file of at most {MAX_BYTES} bytes at {path}")
    return parse_catalog(spark.read.text(path, wholetext=True).first().value)


def catalog_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The patterns as a table: ``pattern_id, regex, regex_length``."""
    return spark.createDataFrame(
        list(catalog.patterns.items()), "pattern_id string, regex string"
    ).withColumn("regex_length", F.length("regex"))
