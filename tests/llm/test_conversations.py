"""Conversation repair against a forward dynamic program over whole strings, and against all edits of short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sitemarks.llm import conversations
from sitemarks.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(case, text)
            out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = SPACE.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    go = lambda state, initial: {"s": "s"}.get(initial) if state == "" and initial == "s" else initial if (initial == "u" and state in ("", "s", "a")) or (initial == "a" and state == "u") else None  # noqa: E731,E501
    best = {"": (0, "", ())}

    def better(into, state, entry):
        if state not in into or entry[:2] < into[state][:2]:
            into[state] = entry

    def inserted(states):
        states = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    if (to := go(state, role[0])) is not None:
                        better(states, to, (cost + 5, audit + "I", (*lines, f"{role}:")))
        return states

    for (_, _, role, text), fault in zip(rows, faults):
        new, late = {}, 5 * (fault == "truncated")
        for state, (cost, audit, lines) in inserted(best).items():
            better(new, state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                if (to := go(state, role[:1])) is not None:
                    better(new, to, (cost + late, audit + "K", (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (to := go(state, other[0])) is not None:
                        better(new, to, (cost + 1 + late, audit + "R", (*lines, f"{other}:{text}")))
        best = new
    cost, audit, lines = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def got(spark, rows, part_bits):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found, parts = conversations.repair(frame.selectExpr("*", "1 AS part", "2 AS n", "'x' AS fault"), part_bits)
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in conversations.digests(parts).collect()}
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *digests[r.conv_id]) for r in found.collect()
    }


def varied(r, n, length):
    texts = ["Yes.", "No", "", " \t", "Why?", "So it is!", "and then", " ", "a\nb.", "é \U0001f389"]
    rows = []
    for conv in [None, *range(n)]:
        for k in range(r.randint(1, length)):
            turn = r.choice([k, k, k, k // 2, None, 3 * k])
            rows.append((conv, turn, r.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User"]), r.choice(texts) + r.choice(["", str(k) + "."])))
    return rows


@pytest.mark.parametrize("part_bits", [1, 3, 12])
def test_equals_forward_program(spark, part_bits):
    rows = varied(random.Random(part_bits), 60, 14)
    rows += [(77, 1, "user", "Same.")] * 9 + [(77, 2, "user", "")] * 5 + [(77, t, "assistant", "Same.") for t in range(20)]
    assert got(spark, rows, part_bits) == {k: repaired(v) for k, v in grouped(rows).items()}


def test_one_long_conversation_in_many_parts(spark):
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{t if r.random() < 0.8 else 'again'}{r.choice(['.', '.', '.', ''])}") for t in range(4000)]
    rows += [(2, t, "user", "") for t in range(3000)] + [(3, 0, "user", f"{t}.") for t in range(2000)]
    assert got(spark, rows, 5) == {k: repaired(v) for k, v in grouped(rows).items()}


def test_all_edits_of_short_conversations():
    """The program of the tests itself against every string of edits, for up to three rows."""
    right = re.compile(r"(s?(ua)+)?$")
    for n in (1, 2, 3):
        for kinds in itertools.product(["u.", "a.", "s.", "u", "t.", ""], repeat=n):
            rows = [(0, i, {"u": "user", "a": "assistant", "s": "system", "t": "tool", "": "user"}[k[:1]], f"{i}{k[1:]}" if k else "") for i, k in enumerate(kinds)]
            best = None
            options = lambda k: ["D"] if not k else ["D", "K", "Ru", "Ra"]
            fills = ["", "u", "a", "ua", "au"]
            for edits in itertools.product(*[options(k) for k in kinds]):
                for gaps in itertools.product(fills, repeat=n + 1):
                    roles, audit, cost = "", "", 0
                    for k, e, g in zip([*kinds, None], [*edits, None], gaps):
                        roles, audit, cost = roles + g, audit + "I" * len(g), cost + 5 * len(g)
                        if e:
                            audit += e[0]
                            cost += {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * (e != "D" and len(k) == 1)
                            roles += "" if e == "D" else k[0] if e == "K" else e[1]
                    if right.match(roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            assert repaired(rows)[5:7] == best, kinds


def test_powers_are_steps():
    for symbol in "suaoSUAOx":
        after = conversations.FINAL
        for n in range(40):
            assert conversations.advance(symbol, n, conversations.FINAL) == after
            after = conversations.advance(symbol, 1, after)


def test_empty_table(spark):
    assert got(spark, [], 12) == {}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = {k: repaired(v) for k, v in grouped(damaged(rows)).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    result = QUERIES["op11_conversation_repair"](spark, sf).collect()
    assert {tuple(r)[0]: tuple(r)[1:] for r in result} == {k: left.get(k, none) for k in grouped(rows)}
    assert len(result) == len(grouped(rows))


def test_damage_of_odd_rows(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, 1, 2, 3, 4, 5, 6, 7) for r in (None, "user") for x in (None, "", "Yes. No")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, conversations.damage(frame).collect()), key=key) == sorted(damaged(rows), key=key)
