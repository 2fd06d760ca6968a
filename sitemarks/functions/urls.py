"""URL functions: normalising, domains, variations and reference resolution.

A URL is split once into a struct of its parts; everything else is built from
that struct. The splitting rules are those of Python's ``urllib.parse``, which
is lenient where ``java.net.URI`` (behind ``parse_url``) gives up with NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemarks.functions.regexes import text

# Which schemes take a network location, a ``;params`` part, relative references.
NETLOC_SCHEMES = ["ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews",
                  "prospero", "rtsp", "rtsps", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
                  "itms-services"]
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp",
                 "tel"]
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
                    "rtsp", "rtsps", "sftp", "svn", "svn+ssh", "ws", "wss"]

_PARTS = text(r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")
_PARAMS = text(r"(?s)^((?:.*/)?[^/;]*);([^/]*)$")
_LEADING = text(r"^[\x00-\x20]+")
_INNER = text(r"[\t\r\n]")
_NAMES = ("scheme", "netloc", "path", "params", "query", "fragment")
DEFAULT_MAX_VARIATIONS = 4


def _in(expr: str, values: list[str]) -> str:
    return f"{expr} IN ({', '.join(map(text, values))})"


def let_sql(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it by ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def clean_sql(url: str) -> str:
    """Drop what URL parsing ignores: leading controls and blanks, inner tabs and line breaks."""
    return f"regexp_replace(regexp_replace({url}, {_LEADING}, ''), {_INNER}, '')"


def split_sql(url: str, default_scheme: str = "''") -> str:
    """Struct ``scheme, netloc, path, params, query, fragment`` (empty string when absent)."""
    part = [f"regexp_extract(_u, {_PARTS}, {i})" for i in range(1, 6)]
    has_params = f"{_in('_r.scheme', PARAM_SCHEMES)} AND _r.path RLIKE {_PARAMS}"
    raw = (
        f"named_struct('scheme', coalesce(nullif(lower({part[0]}), ''), {default_scheme}), 'netloc', {part[1]}, "
        f"'path', {part[2]}, 'query', {part[3]}, 'fragment', {part[4]})"
    )
    cut = (
        "named_struct('scheme', _r.scheme, 'netloc', _r.netloc, "
        f"'path', CASE WHEN {has_params} THEN regexp_extract(_r.path, {_PARAMS}, 1) ELSE _r.path END, "
        f"'params', CASE WHEN {has_params} THEN regexp_extract(_r.path, {_PARAMS}, 2) ELSE '' END, "
        "'query', _r.query, 'fragment', _r.fragment)"
    )
    return let_sql("_u", clean_sql(url), let_sql("_r", raw, cut))


def join_sql(scheme: str, netloc: str, path: str, params: str, query: str, fragment: str) -> str:
    """The URL text for the given parts; empty parts leave no separator behind."""
    with_params = f"CASE WHEN {params} <> '' THEN concat({path}, ';', {params}) ELSE {path} END"
    hier = (
        f"CASE WHEN {netloc} <> '' THEN concat('//', {netloc}, "
        "CASE WHEN _p <> '' AND NOT startswith(_p, '/') THEN '/' ELSE '' END, _p) "
        f"WHEN startswith(_p, '//') OR ({_in(scheme, NETLOC_SCHEMES)} AND (_p = '' OR startswith(_p, '/'))) "
        "THEN concat('//', _p) ELSE _p END"
    )
    whole = (
        f"concat(CASE WHEN {scheme} <> '' THEN concat({scheme}, ':') ELSE '' END, {hier}, "
        f"CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END, "
        f"CASE WHEN {fragment} <> '' THEN concat('#', {fragment}) ELSE '' END)"
    )
    return let_sql("_p", with_params, whole)


def normalize_sql(url: str) -> str:
    scheme = f"regexp_extract({clean_sql(url)}, {_PARTS}, 1)"
    return f"CASE WHEN {scheme} = '' THEN concat('https://', {url}) ELSE {url} END"


def normalize_url(url: str) -> Column:
    """Prepend ``https://`` when the text has no scheme."""
    return F.expr(normalize_sql(url))


def url_domain(url: str) -> Column:
    """The network location as written: port, user info and letter case are kept."""
    return F.expr(f"regexp_extract({clean_sql(url)}, {_PARTS}, 2)")


def url_variations(url: str, max_variations: int = DEFAULT_MAX_VARIATIONS) -> Column:
    """Ordered, distinct alternatives to try when a URL fails.

    In order: toggle ``www.``, toggle the scheme, add a trailing slash, drop
    trailing slashes (never the root one); the URL itself is left out.
    """

    def rebuilt(**changed: str) -> str:
        return join_sql(*[changed.get(n, f"_s.{n}") for n in _NAMES])

    slash = "endswith(_s.path, '/')"
    www = "(CASE WHEN startswith(_s.netloc, 'www.') THEN substr(_s.netloc, 5) ELSE concat('www.', _s.netloc) END)"
    scheme = "(CASE WHEN _s.scheme = 'https' THEN 'http' ELSE 'https' END)"
    candidates = ", ".join(
        [
            rebuilt(netloc=www),
            rebuilt(scheme=scheme),
            f"CASE WHEN NOT {slash} THEN {rebuilt(path="concat(_s.path, '/')")} END",
            f"CASE WHEN {slash} AND _s.path <> '/' THEN {rebuilt(path="rtrim('/', _s.path)")} END",
        ]
    )
    kept = f"filter(array_distinct(array_compact(array({candidates}))), _v -> _v <> {url})"
    return F.expr(let_sql("_s", split_sql(url), f"slice({kept}, 1, {int(max_variations)})"))


def resolve_sql(base: str, reference: str) -> str:
    """Absolute form of a reference found in a page (RFC 3986 with the ``urllib`` corner cases).

    ``base`` is a struct from :func:`split_sql`, so a page splits its own URL once. A
    reference whose network location has one square bracket without the other has no
    absolute form: NULL.
    """
    has_netloc = _in("_f.scheme", NETLOC_SCHEMES)
    netloc = f"(CASE WHEN {has_netloc} THEN {base}.netloc ELSE _f.netloc END)"
    same_page = join_sql(
        "_f.scheme", netloc, f"{base}.path", f"{base}.params",
        f"(CASE WHEN _f.query = '' THEN {base}.query ELSE _f.query END)", "_f.fragment",
    )
    merged = join_sql("_f.scheme", netloc, _merged_path_sql(f"{base}.path", "_f.path"), "_f.params", "_f.query", "_f.fragment")
    choice = (
        f"CASE WHEN _t = '' THEN {join_sql(*[f'{base}.{n}' for n in _NAMES])} "
        f"WHEN _f.scheme <> {base}.scheme OR NOT {_in('_f.scheme', RELATIVE_SCHEMES)} THEN _t "
        f"WHEN {has_netloc} AND _f.netloc <> '' THEN {join_sql(*[f'_f.{n}' for n in _NAMES])} "
        f"WHEN _f.path = '' AND _f.params = '' THEN {same_page} ELSE {merged} END"
    )
    broken = "contains(_f.netloc, '[') <> contains(_f.netloc, ']')"
    choice = f"CASE WHEN {broken} THEN cast(NULL AS string) ELSE {choice} END"
    return let_sql("_t", clean_sql(reference), let_sql("_f", split_sql("_t", f"{base}.scheme"), choice))


def _merged_path_sql(base_path: str, path: str) -> str:
    """Path relative to a base path, with dot segments resolved."""
    folder = f"regexp_extract({base_path}, {text('(?s)^(.*/)[^/]*$')}, 1)"
    joined = f"CASE WHEN startswith({path}, '/') THEN {path} ELSE regexp_replace(concat({folder}, {path}), '/{{2,}}', '/') END"
    walked = (
        "aggregate(split(_m, '/', -1), cast(array() AS array<string>), (_acc, _g) -> "
        "CASE WHEN _g = '..' THEN slice(_acc, 1, greatest(size(_acc) - 1, 0)) WHEN _g = '.' THEN _acc "
        "ELSE concat(_acc, array(_g)) END)"
    )
    ends_in_dots = f"_m RLIKE {text(r'(?:^|/)[.]{1,2}$')}"
    closed = f"array_join(concat({walked}, CASE WHEN {ends_in_dots} THEN array('') ELSE cast(array() AS array<string>) END), '/')"
    plain = "NOT contains(_m, '/.') AND NOT startswith(_m, '.')"
    return let_sql("_m", joined, f"coalesce(nullif(CASE WHEN {plain} THEN _m ELSE {closed} END, ''), '/')")
