"""Conversation structure repair by dynamic programming over runs.

A row's first fault counts: ``blank`` (no character but ASCII white space), ``duplicate``
(role and text seen earlier in its conversation), ``truncated`` (its last such character
ends no sentence). Rows are kept, given another role, or deleted, and empty turns are
inserted, so that the role initials read ``(s?(ua)+)?`` at the least cost; of equally
cheap edits the ASCII-least string of their initials is taken. Blank and duplicate rows
must go.

Method: a row is one of nine symbols (deleted, or initial and truncation). A symbol's step
is a min-plus matrix over the four states of the role pattern: insertions, then the row's
edit. Equal consecutive symbols are one run, and a run of n rows is advanced by the
powers 2^k of its matrix, which are cached. The costs to go at each run's end are known
then, and the choices are unrolled from the front.

A conversation may hold any share of all rows. Rows are range-partitioned by conversation
and order and cut into parts of at most ``2 ** part_bits`` rows. A part is summarised by
its matrix and, per entry state, by the order of the least strings that reach each exit:
rows end every string, so none is the beginning of another, and matrix and order together
say which exit the least audit takes. Only these summaries meet per conversation; then all
parts unroll in parallel. A conversation's audit is one string, so it has fewer than 2^31
rows and some 500,000 summaries at most. Equal rows are one row with a count before they
are ordered, so neither a repeated row nor a long conversation is one task's rows.

Defined results: order is by turn (null first), then role, then text; equal rows are
adjacent. Null roles and texts count as one blank; a null conversation id is a
conversation of its own; a role whose initial is not s, u or a can only be given another
or go; an empty table gives empty tables; other columns are not looked at. Texts are
equal if their SHA-256 digests are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.llm.common import SPACES
from sitemarks.operators.ordered import join_null_safe
from sitemarks.session import written

#: Rows of a part, as a power of two.
PART_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ENDS = ".!?"
_FAR = 1 << 60
#: Characters of a part's tokens up to which a worker keeps its results.
SHORT = 64

# States of the role pattern: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
#: Costs to go after the last row: insertions only.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: Which state a role's initial leads to.
_NEXT = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
_INSERTED = {START: "u", S: "u", U: "a", A: "u"}


# The min-plus algebra of one symbol


@lru_cache(None)
def _options(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edits, next state, cost) of a row in a state, by edits: up to two insertions, then what becomes of the row."""
    out, at = [], state
    for n in range(3):
        role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        out.append(("I" * n + "D", at, n * INSERT + DELETE))
        if symbol != "x":
            if (role, at) in _NEXT:
                out.append(("I" * n + "K", _NEXT[role, at], n * INSERT + KEEP + late))
            new = _INSERTED[at]
            out.append(("I" * n + "R", _NEXT[new, at], n * INSERT + REROLE + late))
        at = _NEXT[_INSERTED[at], at]
    return tuple(sorted(out))


def _times(m: tuple, v: tuple) -> tuple:
    return tuple(min(c + x for c, x in zip(row, v)) for row in m)


@lru_cache(None)
def _power(symbol: str, k: int) -> tuple[tuple[int, ...], ...]:
    """The matrix of 2 ** k equal rows."""
    if k == 0:
        rows = [[_FAR] * 4 for _ in range(4)]
        for state in range(4):
            for _, to, cost in _options(symbol, state):
                rows[state][to] = min(rows[state][to], cost)
        return tuple(map(tuple, rows))
    half = _power(symbol, k - 1)
    columns = [_times(half, column) for column in zip(*half)]
    return tuple(zip(*columns))


def advance(symbol: str, n: int, after: tuple) -> tuple:
    """The costs to go before a run of ``n`` equal symbols, from those after it."""
    k = 0
    while n:
        if n & 1:
            after = _times(_power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


# Runs of a part


def _remembered(f):
    """Short parts come again and again: their results are kept, a bounded number of them."""
    short = lru_cache(1 << 14)(f)
    return wraps(f)(lambda tokens, *more: (short if len(tokens) <= SHORT else f)(tokens, *more))


_TOKEN = re.compile(r"([suaoSUAO])?(?:([wxyz])(\d*))?$")


def _row_symbols(token: str) -> list[tuple[str, int]]:
    """A row's symbols with its number of copies; w, x, y, z are s, u, a and other roles that must go."""
    first, gone, n = _TOKEN.match(token).groups()
    return [(first, 1)] * bool(first) + [(gone, int(n or 1))] * bool(gone)


@_remembered
def _runs(tokens: str) -> tuple[tuple[str, int], ...]:
    out: list[list] = []
    for token in tokens.split(","):
        for symbol, n in _row_symbols(token):
            symbol = "x" if symbol in "wxyz" else symbol
            if out and out[-1][0] == symbol:
                out[-1][1] += n
            else:
                out.append([symbol, n])
    return tuple(map(tuple, out))


def _choices(symbol: str, n: int, state: int, after: tuple) -> Iterator[tuple[str, int]]:
    """The edits of each row of a run, with the state after it. Costs to go are held for a block of rows at a time."""
    block = 4096
    for done in range(0, n, block):
        here = min(block, n - done)
        ahead = [advance(symbol, n - done - here, after)]
        for _ in range(here - 1):
            ahead.append(_times(_power(symbol, 0), ahead[-1]))
        for left in reversed(ahead):
            options = _options(symbol, state)
            least = min(cost + left[to] for _, to, cost in options)
            edits, state = next((e, to) for e, to, cost in options if cost + left[to] == least)
            yield edits, state


@_remembered
def unroll(tokens: str, entry: int, after: tuple) -> tuple[tuple[tuple[str, int], ...], int]:
    """The edits of a part, row by row, with the state each begins in; and the state after the last."""
    runs, ends = _runs(tokens), [after]
    for symbol, n in reversed(runs):
        ends.append(advance(symbol, n, ends[-1]))
    out, state = [], entry
    for (symbol, n), end in zip(runs, reversed(ends[:-1])):
        for edits, to in _choices(symbol, n, state, end):
            out.append((edits, state))
            state = to
    return tuple(out), state


@_remembered
def summary(tokens: str) -> str:
    """``costs|order|first|last|illegal``: matrix, rank of each exit's least string, initials at the ends, pairs out of order."""
    unit = [tuple(0 if i == j else _FAR for i in range(4)) for j in range(4)]
    columns = list(unit)
    for symbol, n in reversed(_runs(tokens)):
        columns = [advance(symbol, n, c) for c in columns]
    costs = [min(columns[t][s], _FAR) for s in range(4) for t in range(4)]
    order = []
    for s in range(4):
        least = ["".join(e for e, _ in unroll(tokens, s, unit[t])[0]) if columns[t][s] < _FAR else "~" for t in range(4)]
        order += [sorted(least).index(x) for x in least]
    initials = [(dict(zip("wxyz", "suao")).get(c, c.lower()), n) for t in tokens.split(",") for c, n in _row_symbols(t)]
    illegal = sum(n - 1 for _, n in initials)
    illegal += sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(initials, initials[1:]))
    return "|".join([",".join(map(str, costs)), ",".join(map(str, order)), initials[0][0], initials[-1][0], str(illegal)])


@lru_cache(1 << 10)
def _read(text: str) -> tuple:
    costs, order, first, last, illegal = text.split("|")
    c, o = list(map(int, costs.split(","))), list(map(int, order.split(",")))
    square = lambda x: tuple(tuple(x[4 * s : 4 * s + 4]) for s in range(4))
    return square(c), square(o), first, last, int(illegal)


def chain(summaries: list[str]) -> tuple[int, int, list[int], list[str]]:
    """Cost and pairs out of order of a conversation; per part its entry state and the costs to go after it."""
    parts = [_read(s) for s in summaries]
    ahead = [FINAL]
    for costs, *_ in reversed(parts):
        ahead.append(_times(costs, ahead[-1]))
    ahead.reverse()
    state, entries = START, []
    for k, (costs, order, *_) in enumerate(parts):
        entries.append(state)
        state = min(range(4), key=lambda t: (costs[state][t] + ahead[k + 1][t], order[state][t]))
    illegal = sum(p[4] for p in parts)
    illegal += sum(a[3] + b[2] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
    return ahead[0][START], illegal, entries, [",".join(map(str, v)) for v in ahead[1:]]


@_remembered
def edits(tokens: str, entry: int, after: str, last: bool) -> tuple[str, str]:
    """A part's audit, and per row what to do: roles to insert before it, then K, D, or the new role's initial as U or A.

    The last part's actions end with the roles to insert after the last row.
    """
    steps, state = unroll(tokens, entry, tuple(map(int, after.split(","))))
    rows, at = [], 0
    for token in tokens.split(","):
        n = sum(k for _, k in _row_symbols(token))
        # All but the first of a row's copies go. D comes before I, so nothing is ever inserted before a row that goes.
        actions = []
        for edit, before in steps[at : at + n]:
            for c in edit:
                if c == "I":
                    actions.append(_INSERTED[before])
                    before = _NEXT[_INSERTED[before], before]
                elif c == "R":
                    actions.append(_INSERTED[before].upper())
                else:
                    actions.append(c)
        kept = [c for c in actions if c != "D"]
        rows.append("".join(kept) or "D")
        at += n
    tail = ""
    while last and state not in (START, A):
        tail += _INSERTED[state]
        state = _NEXT[_INSERTED[state], state]
    audit = "".join(e for e, _ in steps) + "I" * len(tail)
    return audit, ",".join([*rows, tail] if last else rows)


# Rows in order


def _symbols(n: Column) -> Column:
    """A row's token: see ``_row_symbols``."""
    at = F.expr("if(role = '', 0, locate(substring(role, 1, 1), 'sua'))")
    letter = lambda letters: F.substring(F.lit(letters), at + 1, F.lit(1))
    fresh = F.when(F.col("fault") == "truncated", letter("OSUA")).when(F.col("first"), letter("osua")).otherwise("")
    gone = n - F.when(F.col("first"), 1).otherwise(0)
    times = F.when(gone > 1, F.concat(letter("zwxy"), gone.cast("string"))).when(gone == 1, letter("zwxy")).otherwise("")
    return F.concat(fresh, times)


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct rows with ``n`` copies, ``fault``, ``first`` (one copy may stay), and ``pos``, increasing in the order of rows."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).withColumn("hash", F.unhex(F.sha2("text", 256)))
    same = rows.groupBy("conv_id", "turn", "role", "hash").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    same = written(same, "turns")
    # A row is the first of its role and text if it has their smallest turn: a key that also holds the turn is no hot one.
    least = F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))).alias("least")
    firsts = same.groupBy("conv_id", "role", "hash").agg(least).select("conv_id", "role", "hash", F.col("least.turn").alias("turn"))
    firsts = firsts.withColumn("own", F.lit(True))
    body = F.rtrim("text", F.lit(SPACES))
    ends = F.substring(body, -1, 1).isin(*ENDS)
    joined = join_null_safe(same, firsts, ["conv_id", "turn", "role", "hash"], "left").select(
        "conv_id", "turn", "role", "text", "n",
        F.when(body == "", "blank").when(F.col("own").isNull(), "duplicate").when(~ends, "truncated").otherwise("").alias("fault"),
    )
    judged = joined.withColumn("first", ~F.col("fault").isin("blank", "duplicate"))
    judged = written(judged, "turns")
    key = ["conv_id", "turn", "role", "text"]
    ranged = judged.repartitionByRange(*key).sortWithinPartitions(*key)
    return written(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")


def repair(turns: DataFrame, part_bits: int = PART_BITS) -> tuple[DataFrame, DataFrame]:
    """``(conversations, parts)`` of rows ``conv_id, turn, role, text``.

    ``conversations``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``, one row each.
    ``parts``: ``conv_id, part, audit, turns``: the edits and the repaired turns (``role, text``) of consecutive
    rows; all parts of a conversation, by ``part``, are its audit and its repaired rows.
    """
    ordered = _ordered(turns).withColumn("part", F.shiftright("pos", part_bits))
    faulty = lambda name: F.sum(F.when(F.col("fault") == name, F.col("n")).otherwise(0))
    extra = F.col("n") - 1
    stats = ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        faulty("blank").alias("blank"),
        (faulty("duplicate") + F.sum(F.when(F.col("first"), extra).otherwise(0))).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    row = F.struct("pos", _symbols(F.col("n")).alias("token"), "role", "text")
    parts = ordered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    parts = parts.withColumn("tokens", F.array_join(F.col("rows.token"), ","))
    parts = written(parts.withColumn("rows", F.expr("transform(rows, r -> struct(r.role, r.text))")), "turn-parts")

    @F.pandas_udf("string")
    def summarise(tokens: pd.Series) -> pd.Series:
        return tokens.map(summary)

    @F.pandas_udf("struct<cost:bigint,illegal:bigint,entries:array<int>,after:array<string>>")
    def chained(summaries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chain(list(s)) for s in summaries], columns=["cost", "illegal", "entries", "after"])

    @F.pandas_udf("struct<audit:string,actions:string>")
    def act(tokens: pd.Series, entry: pd.Series, after: pd.Series, last: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edits(*x) for x in zip(tokens, entry, after, last)], columns=["audit", "actions"])

    summed = parts.select("conv_id", "part", summarise("tokens").alias("summary"))
    met = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "summary"))).alias("parts"))
    chains = written(met.select("conv_id", F.col("parts.part").alias("parts"), chained("parts.summary").alias("c")), "turn-chains")

    conversations = join_null_safe(stats, chains.select("conv_id", "c.illegal", "c.cost"), ["conv_id"])
    conversations = conversations.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    states = chains.select(
        "conv_id", F.explode(F.arrays_zip("parts", F.col("c.entries").alias("entry"), F.col("c.after").alias("after"))).alias("p"),
        F.element_at("parts", -1).alias("end"),
    )
    states = states.select("conv_id", F.col("p.parts").alias("part"), "p.entry", "p.after", (F.col("p.parts") == F.col("end")).alias("last"))
    acted = join_null_safe(parts, states, ["conv_id", "part"]).withColumn("act", act("tokens", "entry", "after", "last"))
    # Per row: the inserted turns, then the row itself unless it goes; after the last part's rows, more insertions.
    new = "transform(filter(split({}, ''), c -> c in ('u', 'a')), c -> struct(if(c = 'u', 'user', 'assistant') as role, '' as text))"
    role = "case right(a[i], 1) when 'U' then 'user' when 'A' then 'assistant' else r.role end"
    each = f"""transform(rows, (r, i) -> concat({new.format('a[i]')},
        if(right(a[i], 1) = 'D', cast(array() as array<struct<role:string,text:string>>), array(struct({role} as role, r.text as text)))))"""
    tail = new.format("coalesce(get(a, size(rows)), '')")
    made = F.expr(f"transform(array(split(act.actions, ',', -1)), a -> flatten(concat({each}, array({tail}))))[0]")
    repaired = acted.select("conv_id", "part", "act.audit", made.alias("turns"))
    return conversations, repaired


def digests(parts: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of the parts of ``repair``.

    The digest of a text is sequential, so one task reads a conversation's parts in their order,
    as a stream: it holds one batch of parts and the digest so far, besides the audit it returns.
    """
    body = F.array_join(F.expr("transform(turns, t -> concat(t.role, ':', t.text))"), "\n")
    flat = parts.select("conv_id", "part", "audit", F.size("turns").alias("n"), body.alias("body"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, audits, digest, any_turn = None, [], None, False

        def done():
            return (*own, "".join(audits), digest.hexdigest())

        for batch in batches:
            out = []
            for conv, null, audit, n, text in zip(batch["conv"], batch["null"], batch["audit"], batch["n"], batch["body"]):
                if own != (conv, null):
                    if own is not None:
                        out.append(done())
                    own, audits, digest, any_turn = (conv, null), [], hashlib.sha256(), False
                audits.append(audit)
                if n:
                    digest.update(("\n" * any_turn + text).encode("utf-8", "surrogatepass"))
                    any_turn = True
            yield pd.DataFrame(out, columns=["conv", "null", "audit", "repaired_sha256"])
        if own is not None:
            yield pd.DataFrame([done()], columns=["conv", "null", "audit", "repaired_sha256"])

    kind = parts.schema["conv_id"].dataType.simpleString()
    named = flat.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("null"), "part", "audit", "n", "body"
    )
    dealt = named.repartition("conv", "null").sortWithinPartitions("conv", "null", "part")
    found = dealt.mapInPandas(stream, "conv string, `null` boolean, audit string, repaired_sha256 string")
    return found.select(F.expr(f"if(`null`, null, cast(conv as {kind}))").alias("conv_id"), "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults placed by the CRC-32 of ``conv_id:turn``; nulls are one blank."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("case")
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), case).filter("`case` <> 0")
    text = F.expr(f"case `case` when 1 then '' when 2 then translate(text, '{ENDS}', '') else text end")
    role = F.expr("if(`case` = 4, 'user', role)")
    copies = F.explode(F.expr("array_repeat(true, if(`case` = 3, 2, 1))"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_llm_copy")).drop("_llm_copy")
