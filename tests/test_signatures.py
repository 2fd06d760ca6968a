"""Signature matching: rule behaviour, conditions, ids, dedup, pre-filter, custom catalogues."""

import json
import re
from importlib import resources

import pytest
from pyspark.sql import functions as F

from sitemarks.functions.regexes import required_literals, shared_stems
from sitemarks.operators import evidence as ev
from sitemarks.operators.results import detect
from sitemarks.sources.catalog import load_catalog, parse_catalog

GUID = "7be4a1c0-92d3-4f58-8a61-0c9d35e7f214"
LOADER = '<script id="hs-script-loader" async defer src="//js.hs-scripts.com/906713.js"></script>'
PAGES = {
    "loader": LOADER,
    "loader twice": LOADER + LOADER,
    "no id": '<script src="//js.hs-scripts.com/730118.js"></script>',
    "analytics": '<script src="//js.hs-analytics.net/analytics/12345480092/480092.js"></script>',
    "queue": "<script>window._hsq  =window._hsq|| []; _hsq.push([1])</script>",
    "banner": '<script src="https://js.hs-banner.com/hubid.js"></script>',
    "params": '<a href="https://e.com/?a=1&_hsenc=p2A&_hsmi=3">x</a>',
    "cookies": "hubspotutk __hstc hubspotutk HUBSPOTUTK messagesUtk x__hssc",
    "forms": '<script src="//js.hsforms.net/forms/v2.js"></script>hbspt.forms.create({\n portalId: "1",\n formId: "' + GUID + '"\n})',
    "forms loader": '<script src="//js-eu1.hsforms.net/forms/v2.js"></script>',
    "forms call": f"hbspt.forms.create({{portalId: 1, formId: '{GUID}'}})",
    "forms context": '<input name="hs_context">',
    "chat": '<script src="//js.usemessages.com/x.js"></script> https://api.usemessages.com/y',
    "cta": f"<script src='https://js.hscta.net/cta/current.js'></script>hbspt.cta.load(1, '{GUID}')",
    "cta loader": "<script src='//js.hscta.net/cta/current.js'></script>",
    "cta link": f"https://cta-redirect.hubspot.com/cta/redirect/1/{GUID}",
    "meetings": "https://static.hsappstatic.net/MeetingsEmbed/ex/MeetingsEmbedCode.js https://meetings.hubspot.com/a?b&embed=true",
    "generator": "<META charset=x name='generator' lang=en content='hubspot'>",
    "wrapper only": '<div class="hs_cos_wrapper">',
    "wrapper": '<div class="hs_cos_wrapper"><link href="/_hcms/x.css">',
    "host": "https://a.hs-sites-eu1.com/ https://b.hs-sites.org/",
    "files": "https://1.fs1.hubspotusercontent-na1.net/x /hubfs/99/a.png",
    "video": "https://play.hubspotvideo.com/1",
    "email": "https://x.hubspotemail.net/a https://t.hubspotlinks.com/b",
    "clean": "<html><body>months github hubs hsq</body></html>",
    "empty": "",
    "long s": "hubſpotutk and window._hſq = window._hſq || []",
    "kelvin": "meſſagesUtK",
    "dotless": "https://meetıngs.hubspot.com/a?embed=true",
    "around": " hubspotutk éhubspotutk",
    "big id": '<script src="//js.hs-scripts.com/99999999999999999999.js"></script>',
}


def brute_force(html, catalog):
    """The HTML rules by plain ``re`` over one page."""
    flags = re.IGNORECASE | re.MULTILINE
    found = []

    def hit(pattern):
        return pattern is not None and re.search(catalog.patterns[pattern], html, flags) is not None

    for rule in catalog.rules["html"]:
        matches = list(re.finditer(catalog.patterns[rule.pattern], html, flags))
        matches = matches if rule.match_all else matches[:1]
        if (rule.unless and hit(rule.unless)) or (rule.requires and not hit(rule.requires)):
            continue
        level = rule.upgrade_to if rule.upgrade_if and hit(rule.upgrade_if) else rule.confidence
        for m in matches:
            hub_id = int(m.group(rule.id_group)) if rule.id_group else None
            hub_id = hub_id if hub_id is None or hub_id < 2**63 else None
            found.append((rule.category, rule.pattern_id, m.group(0)[:300], hub_id, level))
    return found


@pytest.fixture(scope="module")
def catalog():
    return load_catalog()


@pytest.mark.parametrize("prefilter", [True, False])
def test_html_rules_equal_plain_regexes(spark, page_table, catalog, prefilter):
    texts = list(PAGES.values())
    rows = ev.html_evidence(page_table(*texts), catalog, prefilter).collect()
    for i, (name, html) in enumerate(PAGES.items()):
        ours = [
            (r.category, r.pattern_id, r.match, r.hub_id, r.confidence)
            for r in sorted((r for r in rows if r.page_id == i), key=lambda r: r.seq)
        ]
        assert ours == brute_force(html, catalog), name


def test_rows_without_html_have_no_evidence(page_table):
    assert ev.html_evidence(page_table({"html": None})).count() == 0


def test_result_does_not_depend_on_partitioning(page_table):
    pages = page_table(*PAGES.values())
    one = detect(pages.coalesce(1)).orderBy("page_id").collect()
    assert one == detect(pages.repartition(7)).orderBy("page_id").collect()


def test_network_rules(spark):
    urls = [
        ("https://track.hubspot.com/__ptq.gif?x=1", [("beacon_ptq", "definitive", None)]),
        ("https://track.hubspot.com/__ptq.gif?u=hs-scripts.com/77.js", [("beacon_ptq", "definitive", 77)]),
        ("//js.hs-analytics.net/analytics/1/2.js", [("analytics_core", "definitive", 2)]),
        ("https://js.hs-scripts.com/906713.js", []),
        ("  https://x.hs-sales-engage.com/a ", [("email_hubspot_sales_click", "strong", None)]),
        ("https://js.hsforms.net/forms/v2.js", [("forms_v2_loader", "definitive", None)]),
        ("https://static.hsappstatic.net/MeetingsEmbed/ex/MeetingsEmbedCode.js", [("meetings_embed_js", "definitive", None)]),
        ("", []),
    ]
    table = spark.createDataFrame([(1, i, u) for i, (u, _) in enumerate(urls)], "page_id long, pos int, url string")
    for prefilter in (True, False):
        rows = ev.network_evidence(table, prefilter=prefilter).orderBy("pos", "rule_pos").collect()
        got = {i: [] for i in range(len(urls))}
        for r in rows:
            assert r.match == urls[r.pos][0].strip() and r.source == "url"
            got[r.pos].append((r.pattern_id, r.confidence, r.hub_id))
        assert [got[i] for i in range(len(urls))] == [e for _, e in urls]


def test_static_pages_match_their_own_resources(page_table):
    row = detect(page_table('<script src="//js.hsforms.net/forms/v2.js"></script>')).first()
    assert [(e.source, e.confidence, e.match) for e in row.evidence] == [
        ("html", "strong", "//js.hsforms.net/forms/v2.js"),
        ("url", "definitive", "https://js.hsforms.net/forms/v2.js"),
    ]


def test_captured_requests_replace_the_page_resources(page_table):
    page = {"html": '<script src="//js.hsforms.net/forms/v2.js"></script>', "network": ["https://play.hubspotvideo.com/1"]}
    row = detect(page_table(page)).first()
    assert [e.pattern_id for e in row.evidence if e.source == "url"] == ["video_hubspotvideo"]


def test_first_evidence_wins_and_cookies_are_not_deduplicated(page_table):
    long_url = "https://play.hubspotvideo.com/" + "a" * 400
    page = {
        "html": "hubspotutk hubspotutk __hstc",
        "network": [long_url + "1", long_url + "2", "https://a.hs-sites.com/", long_url + "1"],
        "headers": {"set-cookie": "hubspotutk=1; Path=/, hubspotutk=2; Path=/, __hssc=3"},
    }
    row = detect(page_table(page)).first()
    assert [(e.pattern_id, e.source, e.match[:12], e.confidence) for e in row.evidence] == [
        ("cookie_any", "html", "hubspotutk", "moderate"),
        ("cookie_any", "html", "__hstc", "moderate"),
        ("video_hubspotvideo", "url", "https://play", "strong"),
        ("cms_host_hs_sites", "url", "https://a.hs", "strong"),
        ("cookie_any", "header", "hubspotutk", "definitive"),
        ("cookie_any", "header", "hubspotutk", "definitive"),
        ("cookie_any", "header", "__hssc", "strong"),
    ]
    assert all(len(e.match) <= 300 for e in row.evidence)


@pytest.mark.parametrize(
    "page, names",
    [
        ({"headers": {"Set-Cookie": "messagesUtk=m"}}, ["messagesUtk"]),
        ({"headers": {"set-cookie": "", "Set-Cookie": "__hstc=1"}}, ["__hstc"]),
        ({"headers": {"set-cookie": "a=1"}, "set_cookies": ["hubspotutk=1", None, "__hssc=2"]}, ["hubspotutk", "__hssc"]),
        ({"headers": {}}, []),
    ],
)
def test_cookie_names(page_table, page, names):
    rows = ev.cookie_evidence(page_table({"html": "", **page})).orderBy("seq").collect()
    assert [r.match for r in rows] == names


def test_long_and_array_form_agree(spark, page_table):
    urls = {0: ["https://a.hs-sites.com/x", "https://play.hubspotvideo.com/1", "https://a.hs-sites.com/x"], 1: [], 2: ["x"]}
    pages = page_table(*[{"html": LOADER + "hubspotutk hubspotutk", "network": u, "headers": {"set-cookie": "hubspotutk=1"}} for u in urls.values()])
    network = spark.createDataFrame(
        [(p, i, u) for p, us in urls.items() for i, u in enumerate(us)], "page_id long, pos int, url string"
    )
    long = ev.evidence_rows(pages, network).orderBy("page_id", "seq").drop("seq").collect()
    array = ev.explode_evidence(ev.with_evidence(pages)).orderBy("page_id", "seq").drop("seq").collect()
    assert [r.asDict() for r in long] == [r.asDict() for r in array]


def test_ad_hoc_catalogue_from_a_file(spark, page_table, tmp_path):
    text = {
        "patterns": {"widget": r"\bwidget-(\d+)(?=\.js)", "loader": "load_widgets", "off": "no_widgets"},
        "rules": {
            "html": [
                {"pattern": "widget", "category": "tracking", "confidence": "strong", "id_group": 1, "unless": "off",
                 "requires": "loader", "upgrade_if": "loader", "upgrade_to": "definitive"}
            ]
        },
    }
    path = tmp_path / "catalogue.json"
    path.write_text(json.dumps(text, indent=1))
    catalog = load_catalog(spark, str(path))
    pages = page_table("Widget-12.js load_widgets()", "widget-12.js", "widget-1.js load_widgets no_widgets", "widget-9 load_widgets")
    rows = ev.html_evidence(pages, catalog).collect()
    assert [(r.page_id, r.match, r.hub_id, r.confidence) for r in rows] == [(0, "Widget-12", 12, "definitive")]
    matched = ev.catalog_matches(pages, catalog).groupBy("page_id").agg(F.sort_array(F.collect_list("pattern_id")).alias("p"))
    assert {r.page_id: r.p for r in matched.collect()} == {
        0: ["loader", "widget"], 1: ["widget"], 2: ["loader", "off", "widget"], 3: ["loader"],
    }


@pytest.mark.parametrize(
    "change",
    [
        {"patterns": {"p": "a*"}},
        {"patterns": {"p": "abc"}, "rules": {"html": [{"pattern": "q", "category": "c", "confidence": "strong"}]}},
        {"patterns": {"p": "abc"}, "rules": {"smell": []}},
        {"patterns": {f"p{i}": "abc" for i in range(2001)}},
    ],
)
def test_bad_catalogues_are_rejected(change):
    with pytest.raises(ValueError):
        parse_catalog(json.dumps(change))


@pytest.mark.parametrize(
    "regex, literals",
    [
        (r"abc\d+defgh", [("defgh",), ("abc",)]),
        (r"(?:foobar|barfoo)?xyz", [("xyz",)]),
        (r"(?:foobar|barfoo)", [("foobar", "barfoo")]),
        (r"(?:foobar|b)", []),
        (r"\d+", []),
        (r"ABC+", []),
        (r"(?:ABCD){2}", [("abcd",)]),
    ],
)
def test_required_literals(regex, literals):
    assert required_literals(regex) == literals


def test_stems_are_pieces_of_their_literals(catalog):
    stems = shared_stems(tuple(catalog.first_literals()))
    assert stems and all(stem in literal for literal, stem in stems.items())


def test_builtin_catalogue_is_complete(catalog):
    raw = json.loads(resources.files("sitemarks.sources").joinpath("signatures.json").read_text())
    assert len(catalog.patterns) == 31 == len(raw["patterns"])
    assert [len(catalog.rules[s]) for s in ("html", "url", "cookie")] == [26, 18, 1]


def test_long_matches_are_told_apart_where_the_cut_is_off(page_table):
    from dataclasses import replace

    from sitemarks import detect, load_catalog

    urls = ["https://track.hubspot.com/__ptq.gif?x=" + "a" * 300 + end for end in "12"]
    page = page_table({"html": "", "network": urls})
    counts = []
    for cut in (300, None):
        found = detect(page, replace(load_catalog(), match_chars=cut)).first().evidence
        counts.append(len([e for e in found if e.source == "url" and "__ptq" in e.match]))
    assert counts[1] == 2 * counts[0] > 0
