"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per document. The ledger stores what was measured and
one bit per failed rule; a policy is a versioned mask over these bits, so another
policy, or an ablation of it, reads the ledger and never a text again.

Defined results: a null or empty text has zero words and fails ``few_words``;
repeated rows are judged one by one and each gets its own ledger row; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.llm.common import SPACES, count_of, text_of, words_of

#: Columns that ``ledger`` adds.
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_long_words",
]
BITS = "fail_bits"
#: Words of a repeated window.
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, SQL over the measures, is true."""

    name: str
    fails: str


#: In bit order. New rules go to the end, so that old ledgers keep their meaning.
RULES = [
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("repeated_lines", "10 * n_dup_lines > 8 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("long_words", "10 * n_long_words > n_words"),
]

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ["few_words", "repeated_windows"],
    "prose-2": ["few_words", "repeated_windows", "symbols", "capitals", "repeated_lines", "word_length", "long_words"],
}
CURRENT = "prose-2"


def mask(names: list[str], rules: list[Rule] = RULES) -> int:
    bit = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(bit[name] for name in set(names))


def _repeated_starts() -> Column:
    """Sorted starts of the windows whose words occur twice or more in the text.

    A window is packed into one long: its hash above, its start in the low bits that
    the text's length needs. Sorted longs put equal windows side by side. Where hashes
    agree the words themselves decide: these windows are sorted by their words.
    """
    hashed = ", ".join(f"_llm_w[i + {k}]" for k in range(WINDOW))
    words = ", ".join(f"_llm_w[x.s + {k}]" for k in range(WINDOW))
    return F.expr(
        f"""transform(array(coalesce(length(bin(size(_llm_w))), 0)), b ->
          transform(
            array(sort_array(transform(
              if(size(_llm_w) < {WINDOW}, cast(array() as array<int>), sequence(0, size(_llm_w) - {WINDOW})),
              i -> shiftleft(shiftright(xxhash64({hashed}), b), b) + i))),
            s -> transform(
              array(sort_array(transform(transform(
                filter(s, (x, k) -> shiftright(get(s, k - 1), b) <=> shiftright(x, b)
                                 or shiftright(get(s, k + 1), b) <=> shiftright(x, b)),
                x -> named_struct('s', cast(x & (shiftleft(1L, b) - 1) as int))),
                x -> named_struct('g', concat_ws(' ', {words}), 's', cast(x.s as long))))),
              c -> sort_array(transform(
                filter(c, (x, k) -> get(c, k - 1).g <=> x.g or get(c, k + 1).g <=> x.g), x -> x.s)))[0])[0])[0]"""
    )


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` without its text, plus the measures and ``fail_bits``."""
    names = {text, *MEASURES, BITS}
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    body = docs.select(*others, text_of(f"`{text}`").alias("_llm_text"))
    split = body.withColumns(
        {
            "_llm_w": words_of(F.col("_llm_text")),
            "_llm_l": F.expr(r"filter(split(_llm_text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
        }
    )
    body = F.col("_llm_text")
    counted = split.select(
        *others,
        F.size("_llm_w").cast("long").alias("n_words"),
        (F.length(body) - count_of(SPACES, body)).alias("word_chars"),
        count_of("#*$%&|<>", body).alias("n_symbols"),
        (F.size("_llm_l") - F.size(F.array_distinct("_llm_l"))).cast("long").alias("n_dup_lines"),
        _repeated_starts().alias("_llm_starts"),
        F.size("_llm_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.expr("size(filter(_llm_w, w -> length(w) > 40))").cast("long").alias("n_long_words"),
    )
    covered = F.expr(
        f"""aggregate(_llm_starts, named_struct('n', 0L, 'last', -{WINDOW}L),
              (a, p) -> named_struct('n', a.n + least({WINDOW}L, p - a.last), 'last', p), a -> a.n)"""
    )
    measured = counted.select(*others, *[covered.alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])
    bits = " | ".join(f"if({rule.fails}, {1 << i}L, 0L)" for i, rule in enumerate(rules))
    return measured.withColumn(BITS, F.expr(bits))


def passes(policy: str | list[str], rules: list[Rule] = RULES) -> Column:
    """Whether a ledger row passes a policy: a version of ``POLICIES`` or a list of rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(BITS).bitwiseAND(F.lit(mask(names, rules)).cast("long")) == 0


def ablations(led: DataFrame, policy: str | list[str] = CURRENT, rules: list[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and what the policy keeps without it.

    The ledger is first reduced to its distinct bit masks, at most ``2 ** rules``.
    Returns ``rule``, ``n_failed``, ``n_failed_alone``, ``n_kept``, ``n_kept_without``;
    all zero where the ledger is empty.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(names, rules)
    masks = led.groupBy(F.col(BITS).bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    one = {name: mask([name], rules) for name in names}
    sums = masks.agg(
        *[F.sum(F.when(F.col("bits").bitwiseAND(F.lit(b).cast("long")) != 0, F.col("n")).otherwise(0)).alias(f"f_{n}") for n, b in one.items()],
        *[F.sum(F.when(F.col("bits") == b, F.col("n")).otherwise(0)).alias(f"a_{n}") for n, b in one.items()],
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"), zero(f"f_{n}").alias("n_failed"), zero(f"a_{n}").alias("n_failed_alone"),
                zero("kept").alias("n_kept"), (zero("kept") + zero(f"a_{n}")).alias("n_kept_without"),
            )
            for n in names
        ]
    )
    return sums.select(F.inline(rows))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass a policy, with their columns as they were."""
    # The text goes in under another name: the ledger drops the one it measures.
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    led = ledger(docs.select(carried.alias("_llm_row"), F.col("text")))
    # The generator keeps the filter above it: pushed to the scan, it would split a text again for every word.
    judged = led.select("_llm_row", F.explode(F.array(passes(policy))).alias("_llm_kept"))
    return judged.filter("_llm_kept").select("_llm_row.*")
