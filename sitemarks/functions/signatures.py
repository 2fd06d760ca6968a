"""Signature compiler: catalogue rules become expressions with literal regexes.

Literal regexes are compiled once per task and need no join. Each regex is
guarded by its mandatory literals (see ``regexes.required_literals``): a plain
byte search over the folded text, so a page without vendor markup runs no regex.

All functions take and return SQL text.
"""

from __future__ import annotations

from sitemarks.functions.html import strip_sql
from sitemarks.functions.regexes import folded, java_regex, may_match, text
from sitemarks.schemas import EVIDENCE_DDL
from sitemarks.sources.catalog import Catalog, Rule

NO_TEXTS = "cast(array() AS array<string>)"
NO_EVIDENCE = f"cast(array() AS array<{EVIDENCE_DDL}>)"


def _regex(catalog: Catalog, pattern: str) -> str:
    return text(java_regex(catalog.patterns[pattern]))


def _guarded(catalog: Catalog, pattern: str, folded_expr: str | None, known, expr: str, empty: str) -> str:
    if folded_expr is None:
        return expr
    return f"CASE WHEN {may_match(folded_expr, catalog.literals(pattern), known)} THEN {expr} ELSE {empty} END"


def first_match(catalog: Catalog, pattern: str, expr: str, folded_expr: str | None, known=None) -> str:
    """First match of a pattern, '' when there is none (no signature matches '')."""
    found = f"regexp_extract({expr}, {_regex(catalog, pattern)}, 0)"
    return _guarded(catalog, pattern, folded_expr, known, found, "''")


def all_matches(catalog: Catalog, pattern: str, expr: str, folded_expr: str | None, known=None) -> str:
    """Every match of a pattern in order of appearance."""
    found = f"regexp_extract_all({expr}, {_regex(catalog, pattern)}, 0)"
    return _guarded(catalog, pattern, folded_expr, known, found, NO_TEXTS)


def is_match(catalog: Catalog, pattern: str, expr: str, folded_expr: str | None, known=None) -> str:
    return _guarded(catalog, pattern, folded_expr, known, f"{expr} RLIKE {_regex(catalog, pattern)}", "false")


def _id(expr: str, regex: str, group: int) -> str:
    """Account id in a capture group: NULL when empty or beyond a 64-bit integer."""
    return f"try_cast(nullif(regexp_extract({expr}, {text(java_regex(regex))}, {group}), '') AS bigint)"


def _evidence(catalog: Catalog, rule: Rule, match: str, source: str, hub_id: str, confidence: str) -> str:
    kept = match if catalog.match_chars is None else f"substr({match}, 1, {int(catalog.match_chars)})"
    return (
        f"named_struct('category', {text(rule.category)}, 'pattern_id', {text(rule.pattern_id)}, "
        f"'match', {kept}, 'source', {text(source)}, 'hub_id', {hub_id}, "
        f"'confidence', {confidence}, 'context', cast(NULL AS string))"
    )


_NO_ID = "cast(NULL AS bigint)"


class HtmlRules:
    """The HTML rules of a catalogue, split in two projections.

    ``matches`` is the costly one (regexes over the page); ``evidence`` only
    reads its columns. Keeping them apart lets conditions such as *unless* and
    *upgrade_if* reuse a match instead of running its regex again.
    """

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.rules = catalog.rules.get("html", ())
        self.full = list(dict.fromkeys(r.pattern for r in self.rules))
        conditions = [c for r in self.rules for c in (r.requires, r.unless, r.upgrade_if) if c]
        self.tests = [c for c in dict.fromkeys(conditions) if c not in self.full]
        self._all = {r.pattern for r in self.rules if r.match_all}

    def _name(self, pattern: str) -> str:
        return f"_sig_{(self.full + self.tests).index(pattern)}"

    def matches(self, html: str, folded_html: str | None, known=None) -> list[str]:
        out = []
        for pattern in self.full:
            find = all_matches if pattern in self._all else first_match
            out.append(f"{find(self.catalog, pattern, html, folded_html, known)} AS {self._name(pattern)}")
        for pattern in self.tests:
            out.append(f"{is_match(self.catalog, pattern, html, folded_html, known)} AS {self._name(pattern)}")
        return out

    def _hit(self, pattern: str) -> str:
        name = self._name(pattern)
        if pattern in self.tests:
            return name
        return f"size({name}) > 0" if pattern in self._all else f"{name} <> ''"

    def evidence(self, html: str) -> str:
        """Evidence in rule order, as one array."""
        runs: list[str] = []
        singles: list[str] = []

        def close():
            if singles:
                runs.append(f"array_compact(array({', '.join(singles)}))")
                singles.clear()

        for rule in self.rules:
            condition = f"({self._hit(rule.pattern)})"
            if rule.unless:
                condition += f" AND NOT ({self._hit(rule.unless)})"
            if rule.requires:
                condition += f" AND ({self._hit(rule.requires)})"
            confidence = text(rule.confidence)
            if rule.upgrade_if:
                confidence = f"CASE WHEN {self._hit(rule.upgrade_if)} THEN {text(rule.upgrade_to)} ELSE {confidence} END"
            found = self._name(rule.pattern)
            if rule.pattern in self._all:
                close()
                items = found if rule.match_all else f"slice({found}, 1, 1)"
                one = _evidence(self.catalog, rule, "_m", "html", _NO_ID, confidence)
                runs.append(f"transform(CASE WHEN {condition} THEN {items} ELSE {NO_TEXTS} END, _m -> {one})")
            else:
                # The group is read from the page, not from the match: a regex may look around itself.
                hub_id = _id(html, self.catalog.patterns[rule.pattern], rule.id_group) if rule.id_group else _NO_ID
                singles.append(f"CASE WHEN {condition} THEN {_evidence(self.catalog, rule, found, 'html', hub_id, confidence)} END")
        close()
        return f"concat({', '.join(runs)})" if runs else NO_EVIDENCE


def url_evidence(catalog: Catalog, url: str, folded_url: str | None) -> str:
    """Evidence of one network URL in rule order; the match is the whole URL."""
    found = []
    for rule in catalog.rules.get("url", ()):
        hub_id = _id(url, catalog.patterns[rule.pattern], rule.id_group) if rule.id_group else _NO_ID
        if rule.id_fallback and catalog.id_fallback:
            hub_id = f"coalesce(nullif({hub_id}, 0), {_id(url, catalog.id_fallback, 1)}, {hub_id})"
        hit = is_match(catalog, rule.pattern, url, folded_url)
        found.append(f"CASE WHEN {hit} THEN {_evidence(catalog, rule, url, 'url', hub_id, text(rule.confidence))} END")
    return f"array_compact(array({', '.join(found)}))" if found else NO_EVIDENCE


def any_url_literal(catalog: Catalog, folded_url: str) -> str:
    """False only when no URL rule can match."""
    clauses = dict.fromkeys(tuple(catalog.literals(r.pattern)[:1]) for r in catalog.rules.get("url", ()))
    return " OR ".join(f"({may_match(folded_url, clause)})" for clause in clauses) or "false"


def network_evidence_array(catalog: Catalog, urls: str, prefilter: bool = True) -> str:
    """Evidence of an array of network URLs, URL by URL in order."""
    lines = f"filter(transform(coalesce({urls}, {NO_TEXTS}), _n -> {strip_sql('_n')}), _n -> _n IS NOT NULL AND _n <> '')"
    if not prefilter:
        return f"flatten(transform({lines}, _n -> {url_evidence(catalog, '_n', None)}))"
    pairs = f"transform({lines}, _n -> named_struct('url', _n, 'folded', {folded('_n')}))"
    likely = f"filter({pairs}, _q -> {any_url_literal(catalog, '_q.folded')})"
    return f"flatten(transform({likely}, _q -> {url_evidence(catalog, '_q.url', '_q.folded')}))"


def cookie_evidence_array(catalog: Catalog, cookies: str) -> str:
    """Evidence of ``Set-Cookie`` values: cookie names only, never their contents."""
    parts = []
    for rule in catalog.rules.get("cookie", ()):
        level = text(rule.confidence)
        if rule.upgrade_match:
            level = f"CASE WHEN lower(_o) = {text(rule.upgrade_match)} THEN {text(rule.upgrade_to)} ELSE {level} END"
        names = all_matches(catalog, rule.pattern, "_v", folded("_v"))
        one = f"transform({names}, _o -> {_evidence(catalog, rule, '_o', 'header', _NO_ID, level)})"
        parts.append(f"flatten(transform(filter({cookies}, _v -> _v IS NOT NULL), _v -> {one}))")
    return f"concat({', '.join(parts)})" if parts else NO_EVIDENCE


def set_cookie_values(headers: str, set_cookies: str | None = None) -> str:
    """All ``Set-Cookie`` values of a response: the collected list, else the header in either spelling."""
    value = f"coalesce(nullif(element_at({headers}, 'set-cookie'), ''), element_at({headers}, 'Set-Cookie'))"
    from_map = f"array_compact(array({value}))"
    if set_cookies is None:
        return from_map
    return f"CASE WHEN size(coalesce({set_cookies}, {NO_TEXTS})) > 0 THEN {set_cookies} ELSE {from_map} END"


def first_wins(evidence: str) -> str:
    """Drop later evidence with the same category, pattern, source and match; keeps the order.

    Sort-based (n log n): duplicates become neighbours, the earliest survives,
    and the survivors are put back into their order.
    """
    keyed = (
        f"sort_array(transform({evidence}, (_e, _i) -> named_struct('k', named_struct('c', _e.category, "
        "'p', _e.pattern_id, 's', _e.source, 'm', _e.match), 'i', _i, 'e', _e)))"
    )
    leads = "(_r, _i) -> _i = 0 OR NOT (get(_rows, _i - 1).k <=> _r.k)"
    kept = f"sort_array(transform(filter(_rows, {leads}), _r -> named_struct('i', _r.i, 'e', _r.e)))"
    several = f"element_at(transform(array({keyed}), _rows -> transform({kept}, _r -> _r.e)), 1)"
    return f"CASE WHEN size({evidence}) > 1 THEN {several} ELSE {evidence} END"
