"""The inverted signature index against the unrolled form and against every page and pattern in turn."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitemarks.operators import evidence, signature_index
from sitemarks.plans import derived
from sitemarks.plans.queries import QUERIES
from sitemarks.sources.catalog import catalog_frame, load_catalog

SIGNATURES = "pattern_id string, regex string"
PAGES = "page_id bigint, html string"


def _brute(pages, signatures):
    flags = re.IGNORECASE | re.MULTILINE
    return sorted(
        ((i, p) for i, html in pages for p in {p for p, rx in signatures if p and rx and re.search(rx, html or "", flags)}),
        key=str,
    )


def _got(spark, pages, signatures, **parameters):
    frame = spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' AS gram", "1 AS candidates")
    found = signature_index.indexed_matches(frame, spark.createDataFrame(signatures, SIGNATURES), **parameters)
    return sorted(((r.page_id, r.pattern_id) for r in found.collect()), key=str)


def test_odd_pages_and_patterns(spark):
    signatures = [
        ("plain", "alpha"), ("or", "(alpha|beta)gamma"), ("two", "alpha.*omega"), ("group", r"(?P<id>\d+)-delta"), ("none", r"^\d{3}$"),
        ("short", "ab?c"), ("kelvin", "kite"), ("dup", "alpha"), ("dup", "zeta"), ("long s", "sun-set"), ("quote", "it's [a-z]+"), (None, "alpha"),
        ("null", None), ("han", "漢字.beta"), ("line", "^beta$"),
    ]
    pages = [
        (1, "ALPHA"), (2, "betaGamma alpha"), (3, None), (4, ""), (5, "x" * 5000 + "alpha" + "é" * 300 + "omega"), (6, "77-Delta"), (7, "a\n123\nb"),
        (8, "Kite and ſun-ſet"), (None, "zeta it's me"), (9, "al"), (9, "alpha"), (10, "漢字 beta\nbeta"), (11, "e" * 62 + "alpha"), (12, "e" * 63 + "beta"),
    ]
    expected = _brute(pages, signatures)
    assert _got(spark, pages, signatures) == expected
    assert _got(spark, [], signatures) == [] and _got(spark, pages, []) == []
    with pytest.raises(ValueError):
        _got(spark, pages, signatures, most_without=1)


def test_grams_are_all_grams(spark):
    r = random.Random(6)
    texts = ["", "ab", "abc"] + ["".join(r.choices("abcé漢\U0001f389\n", k=n)) for n in (4, 63, 64, 65, 66, 67, 128, 130, 300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", signature_index.grams("t").alias("g")).collect()
    for row in rows:
        assert sorted(row.g) == sorted({row.t[i : i + 3] for i in range(len(row.t) - 2)})


def test_fifty_thousand_patterns(spark):
    """More patterns than a plan could hold; the rows are those of all pairs."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(5, 9))) for _ in range(50_000)]
    signatures = [(f"p{i}", rf"{w}[.-]v\d" if i % 3 else f"({w}|{words[i - 1]})=") for i, w in enumerate(words)]
    pages = []
    for i in range(40):
        some = [r.choice(words) + r.choice([".v1", "-v", "=", " "]) for _ in range(30)]
        pages.append((i, " ".join(some) + "".join(r.choices("abcdefghijklmnop .-=", k=300))))
    expected = []
    for i, html in pages:
        near = [(p, rx) for k, (p, rx) in enumerate(signatures) if words[k] in html or words[k - 1] in html]
        expected += _brute([(i, html)], near)
    assert len(expected) > 300
    assert _got(spark, pages, signatures) == sorted(expected, key=str)


def test_equals_the_unrolled_form_on_the_archive(spark):
    sites, catalog = derived.sites(spark, "/root/testdata/sf0.01"), load_catalog()
    found = signature_index.indexed_matches(sites, catalog_frame(spark, catalog).select("pattern_id", "regex"))
    rows = lambda df: sorted((r.page_id, r.pattern_id) for r in df.collect())
    assert rows(found) == rows(evidence.catalog_matches(sites, catalog)) != []


def test_plan_joins_by_equality_only(spark):
    plan = QUERIES["catalog_index_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_gram_that_few_pages_hold_is_chosen(spark):
    pages = spark.createDataFrame([(i, "common text " + ("rarely" if i == 7 else "")) for i in range(50)], PAGES)
    grams = pages.select("page_id", F.explode(signature_index.grams("html")).alias("gram"))
    known = signature_index.compiled(spark.createDataFrame([("p", "common text rarely")], SIGNATURES))
    index = signature_index.signature_index(known, grams).collect()
    assert len(index) == 1 and index[0].gram in "text rarely" and index[0].gram not in "common text "
