"""Matching pages against a catalogue that is a table: an inverted index instead of one condition per pattern.

``evidence.catalog_matches`` unrolls a catalogue into the plan, which is best for some hundreds
of patterns and refused beyond ``MAX_PATTERNS``. Here the catalogue stays a table of any size:

1. From each regex come the literals that a match cannot do without (an AND of ORs). Of its most
   selective clause, every alternative is filed under one of its three-character grams: the one
   that the fewest pages hold, counted over all pages.
2. A page's distinct grams meet the index by equality; what meets are candidates.
3. Candidates go back to their page as a list, where all clauses and then the regex are tested.

A literal that a page holds has all its grams there, so no match is lost. Pages are scanned, and
their grams moved at most as rows of (page, gram of the index); a page's text is moved once.
Patterns without a mandatory literal are apart: each is tested on every page, which is all that
can be done, and only as many are taken as the unrolled form takes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.functions.regexes import JAVA_FLAGS, MIN_LITERAL, check_regex, folded, required_literals
from sitemarks.operators.ordered import join_null_safe
from sitemarks.session import written
from sitemarks.sources.catalog import MAX_PATTERNS

GRAM = MIN_LITERAL
#: Characters of a text whose grams are cut at a time: in text that is not ASCII, a substring counts from the start.
PIECE = 64
_CLAUSES = "array<array<string>>"
_LISTED = f"array<struct<pattern_id:string,regex:string,clauses:{_CLAUSES}>>"


def grams(text: str) -> Column:
    """The distinct grams of a text (SQL expression)."""
    pattern = f"(?s)(?=(.{{{GRAM},{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"
    each = f"transform(sequence(1, length(p) - {GRAM - 1}), i -> substring(p, i, {GRAM}))"
    return F.expr(f"array_distinct(flatten(transform(regexp_extract_all({text}, '{pattern}', 1), p -> {each})))")


def compiled(signatures: DataFrame) -> DataFrame:
    """``pattern_id, regex, clauses``: Java regexes, and the literals each needs. A regex that does not compile is an error."""

    @F.pandas_udf(_CLAUSES)
    def clauses(regexes: pd.Series) -> pd.Series:
        out = []
        for regex in regexes:
            check_regex(regex)
            out.append([list(c) for c in required_literals(regex)])
        return pd.Series(out, dtype=object)

    java = F.concat(F.lit(JAVA_FLAGS), F.replace("regex", F.lit("(?P<"), F.lit("(?<")))
    known = signatures.filter("pattern_id IS NOT NULL AND regex IS NOT NULL")
    return known.select("pattern_id", java.alias("regex"), clauses("regex").alias("clauses"))


def signature_index(signatures: DataFrame, page_grams: DataFrame) -> DataFrame:
    """``gram, pattern_id``: where each compiled pattern is filed. ``page_grams`` has ``page_id, gram``."""
    literals = signatures.filter("size(clauses) > 0").select("pattern_id", F.explode(F.col("clauses")[0]).alias("literal"))
    each = literals.select("pattern_id", "literal", F.explode(grams("literal")).alias("gram"))
    held = page_grams.join(each.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("pages"))
    rated = each.join(held, "gram", "left").select("pattern_id", "literal", F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "gram").alias("g"))
    return rated.groupBy("pattern_id", "literal").agg(F.min("g").alias("g")).select(F.col("g.gram").alias("gram"), "pattern_id").distinct()


def indexed_matches(pages: DataFrame, signatures: DataFrame, most_without: int = MAX_PATTERNS) -> DataFrame:
    """``page_id, pattern_id``: every page and pattern that match, as ``evidence.catalog_matches`` gives them.

    ``pages`` has ``page_id, html``; ``signatures`` has ``pattern_id, regex`` (equal ids are one pattern's
    regexes). NULL pages hold nothing, NULL signatures are none. ``most_without``: patterns without
    a mandatory literal; more are an error.
    """
    known = written(compiled(signatures), "signatures")
    texts = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    texts = texts.select("page_id", "html", F.expr(folded("html")).alias("folded"))
    page_grams = texts.select("page_id", F.explode_outer(grams("folded")).alias("gram"))
    index = written(signature_index(known, page_grams), "signature-index")
    met = page_grams.join(index, "gram").select("page_id", "pattern_id").distinct()
    entry = F.struct("pattern_id", "regex", "clauses")
    candidates = met.join(known, "pattern_id").groupBy("page_id").agg(F.collect_list(entry).alias("candidates"))
    always = known.filter("size(clauses) = 0").select("pattern_id", "regex").limit(most_without + 1).collect()
    if len(always) > most_without:
        raise ValueError(f"more than {most_without} patterns without a literal that they need")
    fixed = F.array(*[F.struct(F.lit(r.pattern_id), F.lit(r.regex), F.array().cast(_CLAUSES)) for r in always]).cast(_LISTED)
    both = join_null_safe(texts, candidates, ["page_id"], "left" if always else "inner")
    listed = F.concat(F.coalesce("candidates", F.array().cast(_LISTED)), fixed)
    found = F.expr(
        """transform(filter(listed, c -> forall(c.clauses, o -> exists(o, l -> contains(folded, l))) and html rlike c.regex),
                     c -> c.pattern_id)"""
    )
    return both.withColumn("listed", listed).select("page_id", F.explode(F.array_distinct(found)).alias("pattern_id"))
