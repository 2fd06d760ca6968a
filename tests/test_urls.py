"""URL functions against the standard library."""

from urllib.parse import urljoin, urlsplit

import pytest

from sitemarks.functions import urls as u
from sitemarks.operators import url_prep
from sitemarks.sources.url_lists import read_completed, read_url_list

URLS = [
    "https://example.com", "https://www.example.com/a/", "http://x.org:8080/p?q=1#f", "https://u:p@h.com/", "example.com:8080",
    "https:////a/b", "HTTPS://Www.Ex.com/a;p?x", "https://e.com/a/b;c;d/", "https://e.com/a///", "ftp://h/x;type=a",
    "mailto:a@b", "https://e.com?q", "https://e.com/?", "https://e.com/#", "x:y:z/", "//a/b", "example.com", "", "a_b:c",
]
REFERENCES = [
    "a.js", "/a.js", "//h/x", "?q=1", "#f", "", "../x", "../../../x", "./x", "a/../b", "a/./b/", "..", ".", "a//b",
    "/a//b/../c", "http://o/x", "javascript:x", "data:image/png;base64,AA/..", "g;x=1/../y", ";x", "g?y/./x", "mailto:x",
    "/./a", "/../a", "a/..", "x:y", "//", "ünïcode/ß", "a b",
]
BASES = ["https://e.com/d/p;q?x#f", "https://e.com", "http://e.com/a/b/", "https://e.com//x//y", "ftp://h/a"]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r.x for r in df.selectExpr("i", f"{expression} AS x").orderBy("i").collect()]


def test_split_like_the_standard_library(spark):
    got = column(spark, [(x, "") for x in URLS], u.split_sql("a"))
    for url, parts in zip(URLS, got):
        wanted = urlsplit(url)
        path = parts.path + (f";{parts.params}" if parts.params else "")
        assert (parts.scheme, parts.netloc, path, parts.query, parts.fragment) == tuple(wanted), url


def test_references_resolve_like_the_standard_library(spark):
    pairs = [(b, r) for b in BASES for r in REFERENCES]
    got = column(spark, pairs, u.let_sql("_base", u.split_sql("a"), u.resolve_sql("_base", "b")))
    assert {p: x for p, x in zip(pairs, got)} == {p: urljoin(*p) for p in pairs}


def test_normalize(spark):
    given = ["example.com", "https://example.com", "http://example.com", "example.com:8080", "//a/b", "Ftp://x"]
    assert column(spark, [(x, "") for x in given], u.normalize_sql("a")) == [
        "https://example.com", "https://example.com", "http://example.com", "example.com:8080", "https:////a/b", "Ftp://x",
    ]


def variations(spark, url, limit=4):
    return spark.createDataFrame([(url,)], "a string").select(u.url_variations("a", limit).alias("v")).first().v


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://example.com", ["https://www.example.com", "http://example.com", "https://example.com/"]),
        ("https://www.example.com", ["https://example.com", "http://www.example.com", "https://www.example.com/"]),
        ("http://example.com/", ["http://www.example.com/", "https://example.com/"]),
        ("https://e.com/p/", ["https://www.e.com/p/", "http://e.com/p/", "https://e.com/p"]),
        ("https://e.com/p///", ["https://www.e.com/p///", "http://e.com/p///", "https://e.com/p"]),
        ("https://u:p@e.com:81/p?a=b#c", ["https://www.u:p@e.com:81/p?a=b#c", "http://u:p@e.com:81/p?a=b#c", "https://u:p@e.com:81/p/?a=b#c"]),
        ("http://localhost:3000", ["http://www.localhost:3000", "https://localhost:3000", "http://localhost:3000/"]),
        ("https://blog.e.com", ["https://www.blog.e.com", "http://blog.e.com", "https://blog.e.com/"]),
        ("HTTPS://WWW.e.com/", ["https://www.WWW.e.com/", "http://WWW.e.com/"]),
        ("ftp://e.com/", ["ftp://www.e.com/", "https://e.com/"]),
    ],
)
def test_variations(spark, url, expected):
    assert variations(spark, url) == expected
    for limit in range(4):
        assert variations(spark, url, limit) == expected[:limit]


def test_long_urls_keep_their_path(spark):
    path = "/" + "a" * 5000
    assert all(path in v for v in variations(spark, "https://e.com" + path))


def test_url_list_file_keeps_file_order(spark, tmp_path):
    lines = ["", "# comment", "  https://a.com/ ", "b.com"] + [f"u{i}.com" for i in range(5000)] + ["b.com", "\t", "#x"]
    path = tmp_path / "urls.txt"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = read_url_list(spark, str(path)).orderBy("input_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [line.strip() for line in lines if line.strip() and not line.strip().startswith("#")]
    assert [r.original_url for r in rows] == wanted
    assert [r.input_pos for r in rows[:2]] == [3, 4]


def test_dedup_is_by_exact_text_and_keeps_the_first(spark):
    urls = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, "https://a")], "input_pos long, original_url string")
    rows = url_prep.dedup_urls(urls).orderBy("input_pos").collect()
    assert [(r.input_pos, r.original_url, r.occurrences) for r in rows] == [(1, "b", 1), (2, "a", 2), (4, "https://a", 1)]
    assert url_prep.duplicates_removed(urls).first().asDict() == {"n_inputs": 4, "n_unique": 3, "n_removed": 1}


def test_resume_keeps_repeated_inputs(spark, tmp_path):
    (tmp_path / "done.txt").write_text("b\n\n c \nb\n")
    urls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "input_pos long, original_url string")
    rows = url_prep.pending_urls(urls, read_completed(spark, str(tmp_path / "done.txt"))).orderBy("input_pos").collect()
    assert [(r.input_pos, r.original_url) for r in rows] == [(1, "a"), (3, "a")]


def test_literals_come_after_the_file(spark):
    urls = spark.createDataFrame([(7, "a")], "input_pos long, original_url string")
    rows = url_prep.union_inputs(urls, ["# kept", "a"]).orderBy("input_pos").collect()
    assert [r.original_url for r in rows] == ["a", "# kept", "a"]


def test_waves_bound_each_domain(spark):
    urls = spark.createDataFrame(
        [(i, f"https://{'hot' if i % 3 else 'cold'}.com/{i}") for i in range(400)], "input_pos long, url string"
    )
    rows = url_prep.domain_waves(urls, 5).collect()
    for domain in ("hot.com", "cold.com"):
        waves = [r.wave for r in sorted((r for r in rows if r.domain == domain), key=lambda r: r.input_pos)]
        assert waves == [i // 5 + 1 for i in range(len(waves))]
