"""Every operator on odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from sitemarks.llm import contamination, fixity, lines, pieces, quality, repeats, secret_scan, shards, simhash, urlfilter

PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [
    (1, PROSE, "k"),
    (1, PROSE, "k"),
    (2, None, "_llm_w"),
    (None, PROSE, None),
    (None, None, None),
    (3, "", ""),
    (4, "  \n\t ", " "),
    (5, "x " * 30_000, "long"),
    (6, PROSE.upper() + "\n" + PROSE, "again"),
    (7, "tok\u00e9n = 'abcdefgh' \U0001f389 e\u0301", "marks"),
]
#: Extra columns named like what the operators make or use.
SCHEMA = "doc_id bigint, text string, key string"


def _docs(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.selectExpr("*", "'a' AS line", "1 AS fp", "2 AS shard", "3 AS ids", "4 AS n_words", "5 AS size")


OPERATORS = {
    "secrets": lambda d, s: secret_scan.scan(d),
    "lines": lambda d, s: lines.dedup_lines(d),
    "line decisions": lambda d, s: lines.line_decisions(d),
    "quality": lambda d, s: quality.ledger(d),
    "quality filter": lambda d, s: quality.keep_good(d),
    "shards": lambda d, s: shards.assign(d),
    "repeats": lambda d, s: repeats.remove_repeats(d),
    "near duplicates": lambda d, s: simhash.near_duplicates(d),
    "one of each": lambda d, s: simhash.keep_one(d),
    "hits": lambda d, s: contamination.find_hits(d, _benchmark(s)),
    "decontaminated": lambda d, s: contamination.decontaminate(d, _benchmark(s)),
    "round trip": lambda d, s: pieces.round_trip(d, _model()),
    "tokens": lambda d, s: pieces.decode(pieces.encode(d, _model()), _model()),
}
FILTERS = {"quality filter", "one of each", "decontaminated"}
SAME_COLUMNS = {"lines", "quality filter", "one of each", "decontaminated"}


def _benchmark(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[:13])), (2, None), (None, PROSE), (3, "")], "item_id bigint, text string")


def _model():
    return pieces.load_model(pieces.default_model())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs = _docs(spark)
    out = OPERATORS[name](docs, spark)
    rows = out.collect()
    if name in FILTERS:
        assert len(rows) < len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](_docs(spark, []), spark).collect() == []


def test_odd_urls(spark):
    rows = [(1, "http://WWW.Example.COM/de/x?y"), (2, None), (3, "no scheme"), (4, ""), (5, "http://"), (5, "http://"), (6, "x://a.net#f"), (7, "http://h/" + "p" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' AS host", "'r' AS rule")
    model = urlfilter.train(urlfilter.labels_from_rules(pages))
    got = {(r.page_id, r.host, r.path[:5], r.rule, r.verdict) for r in urlfilter.judge(pages, model).collect()}
    assert (1, "www.example.com", "/de/x", "example.com/de/", "block") in got
    assert (2, "", "", None, "block") in got or (2, "", "", None, "allow") in got
    assert {x[:4] for x in got if x[0] in (3, 4, 5)} == {(i, "", "", None) for i in (3, 4, 5)}
    assert urlfilter.judge(pages.limit(0), model).count() == 0
    none = urlfilter.train(pages.limit(0).selectExpr("url", "1 AS label"))
    assert {r.verdict for r in urlfilter.judge(pages.filter("page_id = 3"), none).collect()} == {"allow"}


def test_rule_without_slash_needs_the_path_to_begin_with_it(spark):
    pages = spark.createDataFrame([(1, "x://a.net"), (2, "x://a.net/"), (3, "x://example.net/en/1"), (4, "x://notexample.net/en/")], "page_id int, url string")
    model = urlfilter.Model(0.0, [0.0] * 8, 8)
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, model).collect()}
    assert got == {1: (None, "allow"), 2: ("net/", "block"), 3: ("example.net/en/", "allow"), 4: ("net/", "block")}


def test_odd_records(spark):
    rows = [("f", 0, b"a"), ("f", 1, None), ("f", 1, b""), ("f", 5, b"x"), ("f", 5, b"x"), (None, 1, b"n"), ("g", None, b"n")]
    one = spark.createDataFrame(rows, "file string, offset bigint, record binary").selectExpr("*", "1 AS hash", "2 AS place")
    two = one.filter("NOT (offset = 5)").unionByName(one.filter("offset = 5").limit(1))
    roots, wrong = fixity.audit(one, one)
    assert [r.equal for r in roots.collect()] == [True] and wrong.count() == 0
    assert [(r.file, r.offset) for r in fixity.audit(one, two)[1].collect()] == [("f", 5)]
    assert fixity.audit(one.limit(0), one.limit(0))[0].count() == 0
    assert sorted(r.offset for r in fixity.audit(one, one.limit(0))[1].collect()) == [0, 1, 5]
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "h"), (2, "u", "")], "page_id bigint, url string, html string")
    assert fixity.warc_records(pages).count() == 3


def test_decontaminate_reads_texts_once(spark):
    """One node of Python finds the hits, one cuts them out."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([("x", "d e f")], "item_id string, text string")
    found = contamination.decontaminate(docs, benchmark)
    assert found._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 2
    assert sorted(map(tuple, found.collect())) == [(1, "a b c"), (2, None)]
