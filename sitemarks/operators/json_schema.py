"""JSON Schema (2020-12) as one column expression over VARIANT.

A schema is compiled, recursively, to an array of problems ``{field, reason}``: static paths
become ``try_variant_get``, open keys and items become ``transform`` over the value's map or
array. Validation of a table is a projection and one ``explode``: no shuffle, no Python.

Checked keywords: ``type`` (one or several), ``enum``, ``const``, ``required``, ``properties``,
``additionalProperties`` (false or a schema), ``minProperties``, ``maxProperties``, ``items``,
``minItems``, ``maxItems``, ``minLength``, ``maxLength``, ``pattern``, ``minimum``, ``maximum``,
``exclusiveMinimum``, ``exclusiveMaximum``, ``format`` (``uri`` and ``date-time``, if asked for),
``allOf``, ``anyOf``, ``oneOf``, ``not``, ``$ref`` to a place in the same document, and the
schemas true and false. Keywords that only describe are skipped; any other is refused, as a
rule that is silently not checked is worse than none. So is a ``$ref`` that leads to itself.

Fields are written like ``summary.features.chat`` and ``evidence[2].match``; the whole is empty.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEMS = "array<struct<field:string,reason:string>>"
#: Keywords that say nothing about what is valid.
DESCRIBING = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
#: Beginnings of the type names of a VARIANT, by JSON type.
KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
#: A scheme and what RFC 3986 allows after it; a date and time with an offset (RFC 3339).
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*$"
DATE_TIME = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def _path(steps: tuple[str, ...]) -> str:
    # A quote in a key cannot be escaped in a path, so such a key is asked for by the other kind of quotes.
    quoted = ['["' + s + '"]' if "'" in s else "['" + s + "']" for s in steps]
    return "$" + "".join(quoted)


class _Compiler:
    def __init__(self, document: Mapping, formats: bool) -> None:
        self.document, self.formats = document, formats

    def problems(self, schema, base: Column, steps: tuple[str, ...], field: Column, seen: tuple[str, ...] = ()) -> Column:
        """The problems of the value at ``steps`` below the variant ``base``; none if there is no value."""
        value = F.try_variant_get(base, _path(steps), "variant") if steps else base
        there = value.isNotNull()
        if schema is True:
            return self._none()
        if schema is False:
            return self._found([there], ["not expected"], field)
        kind = F.schema_of_variant(value)
        unknown = set(schema) - DESCRIBING - set(self._RULES) - {"$ref"}
        if unknown:
            raise ValueError(f"keywords that are not checked: {sorted(unknown)}")
        out = []
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in seen:
                raise ValueError(f"a reference that leads to itself: {ref}")
            out.append(self.problems(self._at(ref), base, steps, field, (*seen, ref)))
        for keyword, rule in self._RULES.items():
            if keyword in schema:
                out.append(rule(self, schema, base, steps, field, seen, value, kind))
        return F.concat(*out) if out else self._none()

    def _at(self, ref: str):
        if not ref.startswith("#"):
            raise ValueError(f"a reference to another document: {ref}")
        place = self.document
        for part in ref[1:].split("/")[1:]:
            place = place[part.replace("~1", "/").replace("~0", "~")]
        return place

    @staticmethod
    def _none() -> Column:
        return F.array().cast(PROBLEMS)

    @staticmethod
    def _found(wrong: list[Column], reasons: list[str], field: Column) -> Column:
        each = [F.when(w, F.struct(field.alias("field"), F.lit(r).alias("reason"))) for w, r in zip(wrong, reasons)]
        return F.array_compact(F.array(*each)).cast(PROBLEMS)

    @staticmethod
    def _below(field: Column, key: Column) -> Column:
        return F.when(field == "", key).otherwise(F.concat(field, F.lit("."), key))

    @staticmethod
    def _is(kind: Column, name: str, value: Column) -> Column:
        if name in KINDS:
            return kind.startswith(KINDS[name])
        if name == "number":
            return kind.rlike(_NUMBER)
        if name == "integer":
            # Trailing zeros are not kept by the parser, so a decimal without a fraction has scale 0.
            number = F.try_variant_get(value, "$", "double")
            return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)") | (kind.rlike("^(DOUBLE|FLOAT)") & (number % 1 == 0))
        raise ValueError(f"not a type: {name}")

    # Rules: (schema, base, steps, field, seen, value, kind) to problems.

    def _type(self, schema, base, steps, field, seen, value, kind) -> Column:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        right = F.lit(False)
        for name in names:
            right = right | self._is(kind, name, value)
        return self._found([value.isNotNull() & ~right], ["wrong type"], field)

    def _equal(self, value: Column, kind: Column, wanted) -> Column:
        if isinstance(wanted, str):
            return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted)
        if wanted is None or isinstance(wanted, bool):
            return F.to_json(value) == json.dumps(wanted)
        if isinstance(wanted, (int, float)):
            return kind.rlike(_NUMBER) & (F.try_variant_get(value, "$", "double") == float(wanted))
        raise ValueError(f"only single values can be compared: {wanted!r}")

    def _enum(self, schema, base, steps, field, seen, value, kind) -> Column:
        texts = [w for w in schema["enum"] if isinstance(w, str)]
        right = (kind == "STRING") & F.try_variant_get(value, "$", "string").isin(texts) if texts else F.lit(False)
        for wanted in schema["enum"]:
            if not isinstance(wanted, str):
                right = right | self._equal(value, kind, wanted)
        return self._found([value.isNotNull() & ~right], ["not allowed"], field)

    def _const(self, schema, base, steps, field, seen, value, kind) -> Column:
        return self._found([value.isNotNull() & ~self._equal(value, kind, schema["const"])], ["not allowed"], field)

    def _required(self, schema, base, steps, field, seen, value, kind) -> Column:
        each = []
        for key in schema["required"]:
            gone = kind.startswith("OBJECT") & F.try_variant_get(base, _path((*steps, key)), "variant").isNull()
            each.append(F.when(gone, F.struct(self._below(field, F.lit(key)).alias("field"), F.lit("missing").alias("reason"))))
        return F.array_compact(F.array(*each)).cast(PROBLEMS) if each else self._none()

    def _properties(self, schema, base, steps, field, seen, value, kind) -> Column:
        each = [
            self.problems(inner, base, (*steps, key), self._below(field, F.lit(key)))
            for key, inner in schema["properties"].items()
        ]
        return F.concat(*each) if each else self._none()

    def _additional(self, schema, base, steps, field, seen, value, kind) -> Column:
        inner, known = schema["additionalProperties"], list(schema.get("properties", {}))
        if inner is True:
            return self._none()
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        if known:
            entries = F.filter(entries, lambda e: ~e["key"].isin(known))
        if inner is False:
            problem = lambda e: F.struct(self._below(field, e["key"]).alias("field"), F.lit("not expected").alias("reason"))
            found = F.transform(entries, problem)
        else:
            found = F.flatten(F.transform(entries, lambda e: self.problems(inner, e["value"], (), self._below(field, e["key"]))))
        return F.coalesce(found.cast(PROBLEMS), self._none())

    def _items(self, schema, base, steps, field, seen, value, kind) -> Column:
        def item(x: Column, i: Column) -> Column:
            return self.problems(schema["items"], x, (), F.concat(field, F.lit("["), i.cast("string"), F.lit("]")))

        found = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), item))
        return F.coalesce(found, self._none())

    @staticmethod
    def _sizes(keyword: str, reason: str):
        of = {
            "Properties": ("OBJECT", lambda v: F.size(F.try_variant_get(v, "$", "map<string,variant>"))),
            "Items": ("ARRAY", lambda v: F.size(F.try_variant_get(v, "$", "array<variant>"))),
            "Length": ("STRING", lambda v: F.length(F.try_variant_get(v, "$", "string"))),
        }[keyword[3:]]

        def rule(self, schema, base, steps, field, seen, value, kind) -> Column:
            size, limit = of[1](value), F.lit(schema[keyword])
            wrong = size < limit if keyword.startswith("min") else size > limit
            return self._found([kind.startswith(of[0]) & wrong], [reason], field)

        return rule

    @staticmethod
    def _limit(keyword: str, reason: str):
        def rule(self, schema, base, steps, field, seen, value, kind) -> Column:
            number, limit = F.try_variant_get(value, "$", "double"), F.lit(float(schema[keyword]))
            right = {
                "minimum": number >= limit, "maximum": number <= limit,
                "exclusiveMinimum": number > limit, "exclusiveMaximum": number < limit,
            }[keyword]
            return self._found([kind.rlike(_NUMBER) & ~right], [reason], field)

        return rule

    def _pattern(self, schema, base, steps, field, seen, value, kind) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return self._found([(kind == "STRING") & ~text.rlike(schema["pattern"])], ["no match"], field)

    def _format(self, schema, base, steps, field, seen, value, kind) -> Column:
        text = F.try_variant_get(value, "$", "string")
        if schema["format"] == "uri":
            right = text.rlike(URI)
        elif schema["format"] == "date-time":
            right = text.rlike(DATE_TIME) & F.try_to_timestamp(F.upper(text)).isNotNull()
        else:
            raise ValueError(f"a format that is not checked: {schema['format']}")
        return self._found([(kind == "STRING") & ~right], ["bad format"], field) if self.formats else self._none()

    def _count(self, schemas, base, steps, field) -> Column:
        """How many of the schemas hold."""
        held = [F.when(F.size(self.problems(s, base, steps, field)) == 0, 1).otherwise(0) for s in schemas]
        return sum(held[1:], held[0])

    def _all(self, schema, base, steps, field, seen, value, kind) -> Column:
        return F.concat(*[self.problems(s, base, steps, field, seen) for s in schema["allOf"]])

    def _any(self, schema, base, steps, field, seen, value, kind) -> Column:
        return self._found([value.isNotNull() & (self._count(schema["anyOf"], base, steps, field) == 0)], ["no alternative"], field)

    def _one(self, schema, base, steps, field, seen, value, kind) -> Column:
        return self._found([value.isNotNull() & (self._count(schema["oneOf"], base, steps, field) != 1)], ["not one alternative"], field)

    def _not(self, schema, base, steps, field, seen, value, kind) -> Column:
        return self._found([value.isNotNull() & (self._count([schema["not"]], base, steps, field) == 1)], ["excluded"], field)

    _RULES = {
        "type": _type, "enum": _enum, "const": _const, "required": _required, "properties": _properties,
        "additionalProperties": _additional, "items": _items, "pattern": _pattern, "format": _format,
        "allOf": _all, "anyOf": _any, "oneOf": _one, "not": _not,
        "minProperties": _sizes("minProperties", "too few keys"), "maxProperties": _sizes("maxProperties", "too many keys"),
        "minItems": _sizes("minItems", "too few items"), "maxItems": _sizes("maxItems", "too many items"),
        "minLength": _sizes("minLength", "too short"), "maxLength": _sizes("maxLength", "too long"),
        "minimum": _limit("minimum", "too small"), "exclusiveMinimum": _limit("exclusiveMinimum", "too small"),
        "maximum": _limit("maximum", "too large"), "exclusiveMaximum": _limit("exclusiveMaximum", "too large"),
    }


def schema_problems(value: Column, schema: Mapping, formats: bool = False) -> Column:
    """The problems of a variant column as ``array<struct<field,reason>>``; a NULL has none."""
    return _Compiler(schema, formats).problems(schema, value, (), F.lit(""))


def strict_json(text: Column) -> Column:
    """Text as a variant; NULL unless it is one JSON value as a whole.

    The parser stops after the first value and takes what follows for granted, so the text is
    parsed as an item of a list that must end as it was made.
    """
    end = "the end of the text"
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{end}"]')))
    ended = (F.try_variant_get(whole, "$[1]", "string") == end) & F.try_variant_get(whole, "$[2]", "variant").isNull()
    return F.when(ended, F.try_variant_get(whole, "$[0]", "variant"))


def json_problems(lines: DataFrame, schema: Mapping, key: str, column: str = "value", formats: bool = False) -> DataFrame:
    """``key, field, reason`` per problem of a column of JSON text; text that is no JSON has just that problem, NULL included."""
    parsed = lines.select(key, strict_json(F.col(column)).alias("_json"))
    unreadable = F.array(F.struct(F.lit("").alias("field"), F.lit("not JSON").alias("reason")))
    found = F.when(F.col("_json").isNull(), unreadable).otherwise(schema_problems(F.col("_json"), schema, formats))
    return parsed.select(key, F.explode(found).alias("_problem")).select(key, "_problem.*")
