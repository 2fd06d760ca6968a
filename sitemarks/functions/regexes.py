"""Regex dialect helpers: Python-style signatures run by Spark's Java engine.

Two things live here: the inline flags that make Java fold case and classify
characters the way Python's ``re`` does, and the derivation of literals that a
text must contain before a signature can possibly match.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

#: d: only \n ends a line, i + U: Unicode case folding and classes, m: multi-line anchors.
JAVA_FLAGS = "(?dimU)"

#: The only non-ASCII characters that case-fold to an ASCII letter (long s, Kelvin sign,
#: dotless i, dotted capital I), and the letters they fold to.
FOLD_FROM = "ſKıİ"
FOLD_TO = "skii"

MIN_LITERAL = 3


def java_regex(regex: str) -> str:
    """A Python regex as a Java one with the signature flags switched on."""
    return JAVA_FLAGS + regex.replace("(?P<", "(?<")


def check_regex(regex: str) -> None:
    """Reject signatures that do not compile or that match nothing at all."""
    if re.compile(regex, re.IGNORECASE | re.MULTILINE).search("") is not None:
        raise ValueError(f"signature matches the empty string: {regex!r}")


@lru_cache(maxsize=10_000)
def required_literals(regex: str, keep: int = 2) -> list[tuple[str, ...]]:
    """Literals a text must hold before the regex can match, as an AND of ORs.

    Each tuple lists lower-case alternatives of which every match holds at least
    one. Only mandatory parts of the regex count, so testing them with
    ``contains`` before running the regex loses nothing. The ``keep`` longest
    (most selective) tuples are returned.
    """
    clauses = _mandatory(sre_parser.parse(regex, re.IGNORECASE | re.MULTILINE))
    clauses = [c for c in dict.fromkeys(clauses) if min(map(len, c)) >= MIN_LITERAL]
    return sorted(clauses, key=lambda c: (-min(map(len, c)), len(c)))[:keep]


def _mandatory(parsed) -> list[tuple[str, ...]]:
    found: list[tuple[str, ...]] = []
    run = ""

    def flush():
        nonlocal run
        if run:
            found.append((run,))
        run = ""

    for op, arg in parsed:
        if op is sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is sre.AT:  # anchors take no characters
            continue
        flush()
        if op is sre.SUBPATTERN:
            found += _mandatory(arg[3])
        elif op is sre.ATOMIC_GROUP:
            found += _mandatory(arg)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            found += _mandatory(arg[2])
        elif op is sre.BRANCH:
            best = [max(_mandatory(b), key=lambda c: min(map(len, c)), default=None) for b in arg[1]]
            if all(best):
                found.append(tuple(dict.fromkeys(lit for clause in best for lit in clause)))
    flush()
    return found


def text(value: str) -> str:
    """A string literal in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded(expr: str) -> str:
    """Text lower-cased so that an ASCII literal is found wherever the signature flags would."""
    odd = " OR ".join(f"contains({expr}, {text(ch)})" for ch in FOLD_FROM)
    return f"lower(CASE WHEN {odd} THEN translate({expr}, {text(FOLD_FROM)}, {text(FOLD_TO)}) ELSE {expr} END)"


def may_match(folded_expr: str, clauses, known: dict[str, str] | None = None) -> str:
    """SQL condition: false only when a mandatory literal is missing from the folded text.

    ``known`` maps literals to the condition to use instead of a plain search.
    """

    def test(literal: str) -> str:
        return (known or {}).get(literal) or f"contains({folded_expr}, {text(literal)})"

    tests = [" OR ".join(f"({test(x)})" for x in options) for options in clauses]
    return " AND ".join(f"({t})" for t in tests) or "true"


@lru_cache(maxsize=16)
def shared_stems(literals: tuple[str, ...], shortest: int = 4) -> dict[str, str]:
    """For literals that have a piece in common, that piece: literal -> stem.

    Searching a page for a stem answers "no" for all its literals at once.
    Greedy: pieces shared by many literals come first, long (rare) ones before short.
    """
    left = list(dict.fromkeys(literals))
    stems: dict[str, str] = {}
    while True:
        pieces = {s[i:j] for s in left for i in range(len(s)) for j in range(i + shortest, len(s) + 1)} | set(left)
        shared = {p: sum(p in s for s in left) for p in pieces}
        best = max(shared, key=lambda p: ((shared[p] - 1) * len(p), p), default=None)
        if best is None or shared[best] < 2:
            return stems
        stems.update({s: best for s in left if best in s})
        left = [s for s in left if best not in s]


class LiteralSearch:
    """The searches for a set of literals over one folded text, stems first."""

    def __init__(self, literals):
        stems = shared_stems(tuple(literals))
        self.stems = {stem: f"_stem_{i}" for i, stem in enumerate(dict.fromkeys(stems.values()))}
        self._stem_of = stems

    def columns(self, folded_expr: str) -> list[str]:
        """One boolean column per stem, to be computed before the conditions."""
        return [f"contains({folded_expr}, {text(stem)}) AS {name}" for stem, name in self.stems.items()]

    def known(self, folded_expr: str) -> dict[str, str]:
        """Condition per literal, reading the stem columns."""
        return {
            literal: self.stems[stem]
            if literal == stem
            else f"{self.stems[stem]} AND contains({folded_expr}, {text(literal)})"
            for literal, stem in self._stem_of.items()
        }
