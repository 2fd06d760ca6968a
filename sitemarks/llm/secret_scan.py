"""Secrets in texts: fixed patterns, and strings that look random to two Markov models (native).

Patterns give the base spans: assigned secrets, access keys and long hexadecimal runs.
The method adds spans: tokens of letters and digits that reach ``least`` characters and
whose characters follow each other as in random strings rather than as in ordinary
identifiers. Both models are first-order Markov chains over 64 character classes and two
ends, backed off to the shares of single classes, trained from labelled samples; a token's score is the
log-likelihood ratio per step.

The query labels its own samples from the whole corpus: what the base patterns find is
random; tokens of letters alone, in one case or with a capital in front, are ordinary.
Counts are sums over all rows, so they grow with the input; what comes to the driver is
one number per pair of classes.

Spans count code points, end exclusive. A token is no span of the method where it
overlaps a base span; where it only touches one, it is. Spans are sorted by start, then
assign, access, hex, markov.

Defined results: a null or empty text has no spans; repeated rows get equal results;
without samples of both kinds the method adds nothing; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.llm.common import text_of

#: The patterns of the contract, the group that must be long, and its least length.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Cheap patterns that find every match of the ones above that is long enough.
_SHORTCUTS = {"hex": r"[0-9a-f]{24,}+", "access": r"AKIA[A-Z0-9]{16,}+"}
METHOD = "markov"
LEAST = 16
#: Tokens of the method, with what may stand in keys and tokens.
TOKEN = r"[A-Za-z0-9+/_=-]"
#: Score per step from which a token is a secret.
THRESHOLD = 0.5
#: Weight of the single characters' shares in each step: what a chain never met after a class, it judges by itself.
BACK_OFF = 10

#: Classes: 26 small letters, 26 capitals, 10 digits, the sign characters together, and anything else; one more for both ends.
CLASSES = 64
END = 64


def _class(code: str) -> str:
    """SQL for the class of a code point."""
    return (
        f"CASE WHEN {code} BETWEEN 97 AND 122 THEN {code} - 97 WHEN {code} BETWEEN 65 AND 90 THEN {code} - 39 "
        f"WHEN {code} BETWEEN 48 AND 57 THEN {code} + 4 WHEN {code} IN (43, 45, 47, 61, 95) THEN 62 ELSE 63 END"
    )


def class_of(character: str) -> int:
    """The same for the tests and for whoever reads a model."""
    c = ord(character)
    return c - 97 if 97 <= c <= 122 else c - 39 if 65 <= c <= 90 else c + 4 if 48 <= c <= 57 else 62 if c in (43, 45, 47, 61, 95) else 63


def _steps(token: str) -> str:
    """SQL for the steps of a token: pairs of classes as one number, with both ends."""
    n = END + 1
    codes = f"transform(sequence(1, length({token})), i -> {_class(f'ascii(substring({token}, i, 1))')})"
    return (
        f"transform(array(concat(array({END}), {codes}, array({END}))), c -> "
        f"transform(sequence(1, size(c) - 1), i -> c[i - 1] * {n} + c[i]))[0]"
    )


def _spans(pattern: str, kind: str, group: int, least: int) -> str:
    """SQL for ``start, kind, finish`` of a pattern's matches in ``_llm_text``.

    What stands between the matches and the matches themselves are two arrays; their
    lengths, summed up in turn, are the places.
    """
    escaped = pattern.replace("\\", "\\\\").replace("'", "\\'")
    matches = f"regexp_extract_all(_llm_text, '{escaped}', 0)"
    own = f"regexp_extract_all(_llm_text, '{escaped}', {group})"
    order = [*PATTERNS, METHOD].index(kind)
    walk = f"""aggregate(sequence(0, size(m) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<s:int,k:int,e:int>>)),
        (a, i) -> named_struct('at', a.at + length(g[i]) + length(m[i]), 'out',
          if(length(o[i]) >= {least}, concat(a.out, array(named_struct('s', a.at + length(g[i]), 'k', {order}, 'e', a.at + length(g[i]) + length(m[i])))), a.out)),
        a -> a.out)"""
    gaps = f"split(_llm_text, '{escaped}', -1)"
    none = "cast(array() as array<struct<s:int,k:int,e:int>>)"
    # Most texts have no match: then nothing is cut up.
    return f"""transform(array({matches}), m -> if(size(m) = 0, {none},
        transform(array({'m' if not group else own}), o -> transform(array({gaps}), g -> {walk})[0])[0]))[0]"""


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_llm_text`` and ``_llm_base``, the base spans as (start, kind, end)."""
    own = docs.withColumn("_llm_text", text_of(f"`{text}`"))
    parts = ", ".join(_spans(_SHORTCUTS.get(k, p), k, g, n) for k, (p, g, n) in PATTERNS.items())
    return own.withColumn("_llm_base", F.expr(f"array_sort(concat({parts}))"))


def with_tokens(based: DataFrame, least: int = LEAST) -> DataFrame:
    """Add ``_llm_tokens``: the tokens of the method as (start, kind, end), those overlapping base spans left out."""
    tokens = _spans(rf"(?<!{TOKEN}){TOKEN}{{{least},}}+", METHOD, 0, least)
    free = "filter(t, x -> not exists(_llm_base, y -> x.s < y.e and y.s < x.e))"
    return based.withColumn("_llm_tokens", F.expr(f"transform(array({tokens}), t -> {free})[0]"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios, random over ordinary, by pair of classes."""

    ratios: list[float]

    def score(self, token: str) -> str:
        """SQL for a token's ratio per step."""
        table = ",".join(f"{r:.9g}" for r in self.ratios)
        return (
            f"transform(array(cast(split('{table}', ',') as array<double>)), r -> transform(array({_steps(token)}), p -> "
            f"aggregate(p, 0.0D, (a, x) -> a + r[x]) / size(p))[0])[0]"
        )


def train(samples: DataFrame, token: str = "token", label: str = "random") -> Model | None:
    """Fit both chains to ``token, random`` (true or false); None without samples of both kinds."""
    rows = samples.select(F.col(token).alias("token"), F.col(label).cast("boolean").alias("random")).filter(
        "random IS NOT NULL AND length(token) > 0"
    )
    # explode_outer: no filter on the size, which would compute the steps twice.
    steps = rows.select("random", F.explode_outer(F.expr(_steps("token"))).alias("step"))
    counts = steps.groupBy("random", "step").count().collect()  # at most two numbers per pair of classes
    n = END + 1
    chains = {}
    for kind in (True, False):
        own = {row["step"]: row["count"] for row in counts if row["random"] == kind}
        if not own:
            return None
        single = [sum(own.get(a * n + b, 0) for a in range(n)) + 1 for b in range(n)]
        chains[kind] = []
        for a in range(n):
            total = sum(own.get(a * n + b, 0) for b in range(n)) + BACK_OFF
            share = BACK_OFF / sum(single)
            chains[kind] += [math.log((own.get(a * n + b, 0) + share * single[b]) / total) for b in range(n)]
    return Model([x - y for x, y in zip(chains[True], chains[False])])


def samples_of(tokened: DataFrame) -> DataFrame:
    """``token, random``: labelled samples from texts with base spans and tokens.

    Random: values of base spans. Ordinary: free tokens without digits and signs whose
    capitals, if any, are all or only the first.
    """
    cut = "substring(_llm_text, x.s + 1, x.e - x.s)"
    value = r"regexp_extract(v, '[A-Za-z0-9+/_=-]+$', 0)"
    base = f"transform(_llm_base, x -> transform(array({cut}), v -> named_struct('token', {value}, 'random', true))[0])"
    free = f"transform(_llm_tokens, x -> named_struct('token', {cut}, 'random', false))"
    ordinary = "filter(f, x -> x.token rlike '^([A-Z]?[a-z]+|[A-Z]+)$')"
    both = tokened.select(F.expr(f"concat({base}, transform(array({free}), f -> {ordinary})[0])").alias("s"))
    return both.select(F.explode_outer("s").alias("s")).select("s.token", "s.random").filter("random IS NOT NULL")


def found(tokened: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``_llm_spans``: base spans and those the method adds, sorted."""
    if model is None:
        return tokened.withColumn("_llm_spans", F.col("_llm_base"))
    score = model.score("substring(_llm_text, x.s + 1, x.e - x.s)")
    extra = f"filter(_llm_tokens, x -> {score} >= {threshold!r})"
    return tokened.withColumn("_llm_spans", F.expr(f"array_sort(concat(_llm_base, {extra}))"))


def scan(docs: DataFrame, model: Model | None = None, text: str = "text", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``secrets``: array of (start, end, kind). Without a model, one is trained from ``docs``."""
    tokened = with_tokens(with_base_spans(docs, text), least)
    model = train(samples_of(tokened)) if model is None else model
    kinds = ", ".join(f"'{k}'" for k in [*PATTERNS, METHOD])
    named = F.expr(f"transform(_llm_spans, x -> named_struct('start', x.s, 'end', x.e, 'kind', array({kinds})[x.k]))")
    out = found(tokened, model, threshold).withColumn("secrets", named)
    return out.drop("_llm_text", "_llm_base", "_llm_tokens", "_llm_spans")


def digest(secrets: str = "secrets") -> tuple[Column, Column]:
    """Base spans and all spans, as ``kind:start:end`` joined by commas."""
    text = "transform({}, x -> concat_ws(':', x.kind, x.start, x.end))"
    base = F.expr(f"array_join({text.format(f'''filter({secrets}, x -> x.kind <> '{METHOD}')''')}, ',')")
    return base, F.expr(f"array_join({text.format(secrets)}, ',')")
