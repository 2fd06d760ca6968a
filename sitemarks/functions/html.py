"""HTML functions: resource links and page metadata by tokenising regexes.

Spark has no HTML parser, so these read the tokens that matter (opening tags,
comments, script and style bodies) with possessive regexes: those neither
backtrack nor recurse, so a hostile or huge page costs linear time and no stack.
Known limit against a tree parser: tags that an error-repairing parser would
invent are not seen.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemarks.functions.regexes import text
from sitemarks.functions.urls import let_sql, resolve_sql, split_sql

#: Tag and attribute pairs that load something into a page (fixed values).
RESOURCE_TAGS = {"script": "src", "link": "href", "iframe": "src"}

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_COMMENT = r"<!--(?:.*?-->|.*+)"
_RAW_END = r"(?:.*?</(?:script|style)\s*+>|.*+)"
_RAW = r"<(?:script|style)(?=[\s/>])" + _ATTRS + ">" + _RAW_END
_ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,10});?"
_BLANK = r"[\s\x1c-\x1f]"
_NAMES = "map({})".format(", ".join(f"{text(n)}, {text(chr(c))}" for n, c in sorted({**name2codepoint, "apos": 39}.items())))


def tags_sql(html: str, tags) -> str:
    """Opening tags of the given kinds in document order; comments and raw text are skipped."""
    plain = "|".join(t for t in tags if t not in ("script", "style")) or "(?!)"
    # The empty group 2 takes part for script and style only; the back-reference then lets the body be skipped.
    opening = rf"(<(?:(?:script|style)(?=[\s/>])()|(?:{plain})(?=[\s/>])){_ATTRS}>)"
    regex = rf"(?is){_COMMENT}|{opening}(?:\2{_RAW_END})?+"
    found = f"regexp_extract_all({html}, {text(regex)}, 1)"
    unwanted = "|".join(t for t in ("script", "style") if t not in tags)
    extra = f" AND NOT _k RLIKE {text(rf'(?i)^<(?:{unwanted})(?=[\s/>])')}" if unwanted else ""
    return f"filter({found}, _k -> _k <> ''{extra})"


def tag_name_sql(tag: str) -> str:
    return f"lower(regexp_extract({tag}, '^<([A-Za-z]+)', 1))"


def attribute_sql(tag: str, name: str) -> str:
    """Value of the first such attribute of an opening tag as written, NULL when absent or empty."""
    other = rf"""(?!{name}[\s=/>])[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
    regex = rf"""(?is)^<[a-z]++(?:[\s/"']++|{other})*+{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    value = f"CASE WHEN left(_w, 1) IN ('\"', '\\'') THEN substr(_w, 2, length(_w) - 2) ELSE _w END"
    return let_sql("_w", f"regexp_extract({tag}, {text(regex)}, 1)", f"nullif({value}, '')")


def unescape_sql(expr: str) -> str:
    """Character references replaced by their characters (numeric and the HTML 4 names)."""
    entity = text(_ENTITY)
    # More digits than any code point needs are no code point, so they need not fit a number either.
    digits = "regexp_extract(_b, '^#[xX]?0*(.*)$', 1)"
    number = f"CASE WHEN lower(left(_b, 2)) = '#x' THEN conv({digits}, 16, 10) ELSE {digits} END"
    code = f"CASE WHEN length({digits}) BETWEEN 1 AND 7 THEN try_cast({number} AS int) ELSE 0 END"
    valid = "_c > 0 AND _c <= 1114111 AND NOT _c BETWEEN 55296 AND 57343"
    char = f"CASE WHEN {valid} THEN decode(unhex(lpad(hex(_c), 8, '0')), 'UTF-32') ELSE '�' END"
    decoded = let_sql(
        "_b",
        f"regexp_extract(_e, {entity}, 1)",
        f"CASE WHEN startswith(_b, '#') THEN {let_sql('_c', code, char)} ELSE coalesce(element_at({_NAMES}, _b), _e) END",
    )
    chars = f"concat(transform(regexp_extract_all(_x, {entity}, 0), _e -> {decoded}), array(''))"
    joined = f"array_join(zip_with(split(_x, {entity}, -1), {chars}, (_l, _d) -> concat(_l, coalesce(_d, ''))), '')"
    return let_sql("_x", expr, f"CASE WHEN contains(_x, '&') THEN {joined} ELSE _x END")


def strip_sql(expr: str) -> str:
    """Trim like Python's ``str.strip``: every Unicode blank, not just the space."""
    return f"regexp_replace({expr}, {text(rf'(?U)^{_BLANK}+|{_BLANK}+$')}, '')"


def page_resources(html: str, page_url: str, tags: dict[str, str] = RESOURCE_TAGS) -> Column:
    """Absolute URLs a page loads: distinct, in document order of first appearance."""
    cases = " ".join(f"WHEN {text(name)} THEN {attribute_sql('_g', attr)}" for name, attr in tags.items())
    links = f"transform({tags_sql(html, list(tags))}, _g -> CASE {tag_name_sql('_g')} {cases} END)"
    present = f"filter({links}, _h -> _h IS NOT NULL)"
    absolute = f"transform(transform({present}, _h -> {unescape_sql('_h')}), _a -> {resolve_sql('_base', '_a')})"
    return F.expr(let_sql("_base", split_sql(page_url), f"array_distinct(array_compact({absolute}))"))


def page_title(html: str) -> Column:
    """Text of the first ``<title>``, trimmed; NULL when absent or blank. An unclosed title runs to the end."""
    skip = rf"[^<]++|{_COMMENT}|{_RAW}|<(?!title[\s/>])"
    regex = rf"(?is)\A(?:{skip})*+<title(?=[\s/>]){_ATTRS}>(.*?)(?:</title|\z)"
    return F.expr(f"nullif({strip_sql(unescape_sql(f'regexp_extract({html}, {text(regex)}, 1)'))}, '')")


def page_description(html: str) -> Column:
    """Content of the first ``<meta name="description">``, trimmed; NULL when absent or blank."""
    named = f"filter({tags_sql(html, ['meta'])}, _g -> {attribute_sql('_g', 'name')} = 'description')"
    content = let_sql("_d0", f"get({named}, 0)", attribute_sql("_d0", "content"))
    value = f"nullif({strip_sql(unescape_sql(content))}, '')"
    return F.expr(f"CASE WHEN contains({html}, 'description') THEN {value} END")
