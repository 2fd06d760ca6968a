"""JSON Schemas over VARIANT: every rule of the result schema broken once, and each keyword by itself."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from sitemarks.operators.json_schema import json_problems, schema_problems
from sitemarks.operators.validation import RESULT_SCHEMA, json_violations

GOOD = {
    "original_url": "https://a.com", "final_url": "https://a.com/", "timestamp": "2024-05-01T10:00:00Z", "hubspot_detected": True,
    "hubIds": [5, 99999999999999999999], "headers": {"a": "b"}, "http_status": 200, "extra": {"any": ["thing"]},
    "summary": {
        "tracking": True, "cmsHosting": False, "confidence": "weak",
        "features": {"forms": True, "chat": False, "ctasLegacy": False, "meetings": False, "video": False, "emailTrackingIndicators": False},
    },
    "evidence": [
        {"category": "forms", "patternId": "p", "match": "m", "source": "html", "hubId": None, "confidence": "strong", "context": None},
        {"category": "chat", "patternId": "q", "match": "", "source": "url", "hubId": 7, "confidence": "weak"},
    ],
    "page_metadata": {"title": None, "description": "d"},
    "url_variation": {"original_url": "http://a.com", "working_url": "https://a.com/", "variation_type": "auto"},
}


def _broken():
    """(changed document, expected problems) for every rule of the schema."""
    out = []

    def change(path, value, *problems, gone=False):
        doc = copy.deepcopy(GOOD)
        at = doc
        for step in path[:-1]:
            at = at[step]
        if gone:
            del at[path[-1]]
        else:
            at[path[-1]] = value
        out.append((doc, sorted(problems)))

    def walk(schema, path, field):
        schema = RESULT_SCHEMA["$defs"]["Evidence"] if "$ref" in schema else schema
        if path:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            wrong = 1.5 if "boolean" not in kinds else "true"
            change(path, wrong, (field, "wrong type"), *([(field, "not allowed")] if "enum" in schema else []))
            if "null" not in kinds:
                change(path, None, (field, "wrong type"), *([(field, "not allowed")] if "enum" in schema else []))
        if "enum" in schema:
            change(path, "nothing", (field, "not allowed"))
        if schema.get("format") == "uri":
            change(path, "no uri", (field, "bad format"))
        if schema.get("format") == "date-time":
            change(path, "2024-13-01T10:00:00Z", (field, "bad format"))
            change(path, "2024-05-01 10:00:00", (field, "bad format"))
        below = lambda key: f"{field}.{key}" if field else key
        for key in schema.get("required", []):
            change((*path, key), None, (below(key), "missing"), gone=True)
        if schema.get("additionalProperties") is False:
            change((*path, "it's new"), 1, (below("it's new"), "not expected"))
        if isinstance(schema.get("additionalProperties"), dict):
            change((*path, "c d"), 1, (below("c d"), "wrong type"))
        for key, inner in schema.get("properties", {}).items():
            walk(inner, (*path, key), below(key))
        if "items" in schema:
            walk(schema["items"], (*path, 1), f"{field}[1]")

    walk(RESULT_SCHEMA, (), "")
    return out


def test_every_rule_broken_once(spark):
    cases = _broken()
    assert len(cases) > 90
    assert len({tuple(p) for _, p in cases}) > 60
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)] + [(-1, json.dumps(GOOD))]
    frame = spark.createDataFrame(rows, "k int, value string")
    got = {}
    for r in json_violations(frame, key="k", formats=True).collect():
        got.setdefault(r.k, []).append((r.field, r.reason))
    assert -1 not in got
    for i, (_, problems) in enumerate(cases):
        assert sorted(got.get(i, [])) == problems, cases[i]
    without = json_violations(frame, key="k")
    assert without.filter("reason = 'bad format'").count() == 0


def _problems(spark, schema, *values, formats=True):
    rows = [(i, v if isinstance(v, str) or v is None else json.dumps(v[0])) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k int, value string")
    out = [[] for _ in values]
    for r in json_problems(frame, schema, "k", formats=formats).collect():
        out[r.k].append((r.field, r.reason))
    return [sorted(x) for x in out]


#: Schema, and values (wrapped in a tuple) with their problems.
KEYWORDS = [
    ({"type": "integer"}, [((1,), []), ((1.0,), []), ((1e300,), []), ((1.5,), [("", "wrong type")]), (("1",), [("", "wrong type")])]),
    ({"type": ["number", "null"]}, [((1.5,), []), ((None,), []), ((True,), [("", "wrong type")])]),
    ({"enum": ["a", 1, None, True]}, [(("a",), []), ((1.0,), []), ((None,), []), ((True,), []), ((False,), [("", "not allowed")]), (("1",), [("", "not allowed")])]),
    ({"const": 2}, [((2,), []), ((3,), [("", "not allowed")])]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, [(("ab",), []), (("a",), [("", "too short")]), (("bcde",), [("", "no match"), ("", "too long")]), ((7,), [])]),
    ({"minimum": 1, "exclusiveMaximum": 3}, [((1,), []), ((3,), [("", "too large")]), ((0.5,), [("", "too small")]), (("x",), [])]),
    ({"exclusiveMinimum": 1, "maximum": 3}, [((1,), [("", "too small")]), ((3,), []), ((3.1,), [("", "too large")])]),
    ({"minItems": 1, "maxItems": 2, "items": {"type": "string"}}, [((["a"],), []), (([],), [("", "too few items")]), ((["a", 1, "c"],), [("", "too many items"), ("[1]", "wrong type")])]),
    ({"minProperties": 1, "maxProperties": 1}, [(({"a": 1},), []), (({},), [("", "too few keys")]), (({"a": 1, "b": 2},), [("", "too many keys")])]),
    ({"items": {"items": {"type": "integer"}}}, [(([[1], [2, "x"]],), [("[1][1]", "wrong type")]), (([],), []), (("x",), [])]),
    ({"additionalProperties": {"items": {"type": "integer"}}}, [(({"a": [1], "b c": ["x"]},), [("b c[0]", "wrong type")])]),
    ({"properties": {"a": False, "b": True}}, [(({"b": 1},), []), (({"a": 1},), [("a", "not expected")])]),
    ({"allOf": [{"type": "string"}, {"minLength": 2}]}, [(("ab",), []), (("a",), [("", "too short")]), ((1,), [("", "wrong type")])]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, [(("a",), []), ((6,), []), ((1,), [("", "no alternative")])]),
    ({"oneOf": [{"type": "integer"}, {"type": "number"}]}, [((1.5,), []), ((1,), [("", "not one alternative")])]),
    ({"not": {"type": "string"}}, [((1,), []), (("a",), [("", "excluded")])]),
    ({"$defs": {"a/b": {"type": "string"}}, "items": {"$ref": "#/$defs/a~1b"}}, [((["x", 1],), [("[1]", "wrong type")])]),
    ({"format": "date-time"}, [(("2024-02-29T23:59:59.5+01:00",), []), (("2023-02-29T00:00:00Z",), [("", "bad format")]), ((1,), [])]),
    ({"format": "uri"}, [(("urn:a:b",), []), (("//a.com",), [("", "bad format")]), (("http://a b",), [("", "bad format")])]),
]


@pytest.mark.parametrize("number", range(len(KEYWORDS)))
def test_keywords(spark, number):
    schema, cases = KEYWORDS[number]
    assert _problems(spark, schema, *[v for v, _ in cases]) == [sorted(p) for _, p in cases]


def test_text_that_is_no_json(spark):
    not_json = [("", "not JSON")]
    assert _problems(spark, {"type": "object"}, "{nope", None, "", "{}", "null") == [not_json, not_json, not_json, [], [("", "wrong type")]]
    rest = ['"a": 1}', "{} {}", "{}, {}", "{}]", "{}}", "[1", " ", '{"a": 1', "{} x"]
    assert _problems(spark, {"type": "object"}, *rest) == [not_json] * len(rest)
    assert _problems(spark, {"type": "object"}, " {} \n", '{"a":\n[]}') == [[], []]


@pytest.mark.parametrize(
    "schema",
    [
        {"unevaluatedProperties": False}, {"type": "text"}, {"format": "email"}, {"$ref": "other.json"}, {"enum": [[1]]},
        {"$defs": {"a": {"allOf": [{"$ref": "#/$defs/a"}]}}, "$ref": "#/$defs/a"},
    ],
)
def test_what_is_not_checked_is_refused(spark, schema):
    with pytest.raises(ValueError):
        schema_problems(F.col("v"), schema, formats=True)


def test_plan_has_no_shuffle_and_no_python(spark):
    frame = spark.range(3).selectExpr("id AS k", "'{}' AS value")
    plan = json_violations(frame, key="k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
