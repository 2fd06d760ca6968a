"""The grouped prefix join against all pairs of documents."""

import random
import re

import numpy as np
import pytest

from sitemarks.llm import ngramjoin
from sitemarks.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(rows, percent=90):
    """Per row (size of its set, smallest doc_id reachable)."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)), key=lambda v: (v is not None, v))
                root[high] = low
    return sorted(((d, len(s), find(d)) for d, s in sets), key=str)


def varied(r, families, spread):
    words = ["w%d" % i for i in range(3000)]
    common = [r.choices(words, k=60) for _ in range(3)]
    texts = []
    for _ in range(families):
        body = r.choices(words, k=r.randint(1, 220))
        for _ in range(r.randint(1, spread)):
            own = list(body)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.4:
                own = [*own, *r.choice(common)]
            if r.random() < 0.2:
                own = own[: len(own) - len(own) // 20]
            texts.append(" ".join(own) if r.random() < 0.7 else "\n".join(own).upper())
    r.shuffle(texts)
    return texts


def found(spark, rows, **parameters):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS gid", "3 AS token")
    documents, _ = ngramjoin.similar_documents(frame, **parameters)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in documents.collect()), key=str)


@pytest.mark.parametrize("percent, rounds", [(90, 2), (70, 1), (100, 0)])
def test_equals_all_pairs(spark, monkeypatch, percent, rounds):
    monkeypatch.setattr(ngramjoin, "LOCAL", 2)
    rows = list(enumerate(varied(random.Random(percent), 60, 9)))
    assert found(spark, rows, percent=percent, rounds=rounds) == expected(rows, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [
        (5, long), (5, long), (3, long.upper()), (4, long + " x"), (None, long + " x y"), (None, "other text here"), (7, None), (8, ""),
        (9, " \n\t"), (10, "one two"), (11, "ONE\x0bTWO"), (12, "one"), (13, "one two one"), (14, "a b c\u0085d e"), (15, "A b c\u0085d e"),
        (16, "É a b"), (17, "é a b"), (18, "x " * 30_000), (19, "x x x"), (5, "text of another kind"), (20, "text of another kind"), (21, "one two one two"),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


def test_chains_in_one_list(spark, monkeypatch):
    """A family whose members are similar to few others only, all in the same lists, and outsiders among them."""
    r = random.Random(2)
    words = ["v%d" % i for i in range(1200)]
    chain = [" ".join(words[4 * i : 4 * i + 160]) for i in range(200)]
    rows = list(enumerate(r.sample(chain, 170)))
    monkeypatch.setattr(ngramjoin.Order, "ranks", lambda self, x: (x % np.uint64(7)).astype(np.int64))
    assert found(spark, rows) == expected(rows)


def test_family_that_hangs_together_loosely(spark, monkeypatch):
    """Members link where they share an edit, to a few others only; the one component is found without all pairs."""
    base = [f"b{i}" for i in range(120)]
    member = lambda *edits: " ".join(f"e{i}" if (i - 5) // 7 in edits and i % 7 == 5 else w for i, w in enumerate(base))
    rows = list(enumerate(member(i, j) for i in range(16) for j in range(i)))
    verified, pairs = ngramjoin._verified, []
    monkeypatch.setattr(ngramjoin, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    monkeypatch.setattr(ngramjoin, "CENTRES", 4, raising=False)
    monkeypatch.setattr(ngramjoin.Order, "ranks", lambda self, x: (x % np.uint64(7)).astype(np.int64))
    assert found(spark, rows, rounds=0) == expected(rows)
    assert sum(pairs) < len(rows) * (len(rows) - 1) / 4


def test_equal_prefixes(spark, monkeypatch):
    """Sets of one size that differ behind their prefixes only: one group, expanded where it holds several components."""
    base = [f"b{i}" for i in range(200)]
    rows = [(k, " ".join([*base[:130], *[f"x{k}_{i}" for i in range(6 if k % 3 else 20)], *base[130 : 200 if k % 3 else 186]])) for k in range(40)]
    monkeypatch.setattr(ngramjoin.Order, "ranks", lambda self, x: np.isin(x, BASE, invert=True).astype(np.int64))
    global BASE
    BASE = ngramjoin.Sets().of(" ".join(base[:130]))
    assert found(spark, rows) == expected(rows)


def test_prefixes_allow_every_link():
    r = random.Random(9)
    for _ in range(3000):
        own = r.sample(range(10**6), r.randint(1, 80))
        other = [x for x in own if r.random() > 0.06] + r.sample(range(10**6), r.randint(0, 6))
        a, b = (np.array(sorted(set(x)), np.uint64) for x in (own, other))
        if not len(b):
            continue
        frequent = np.array(r.sample(own, len(own) // 3), np.uint64)
        order = ngramjoin.Order(frequent, np.arange(1, len(frequent) + 1))
        shared = len(np.intersect1d(a, b))
        if 190 * shared >= 90 * (len(a) + len(b)):
            assert order.may_link(order.prefix(a, 90), order.prefix(b, 90), len(a), len(b), 90)
            assert len(np.intersect1d(order.prefix(a, 90), order.prefix(b, 90)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_ngram_join"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == expected(rows)


def test_only_new_words_are_hashed(monkeypatch):
    sets, digest, hashed = ngramjoin.Sets(), ngramjoin.xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(ngramjoin.xxhash, "xxh3_64_intdigest", lambda *a: hashed.append(a[0]) or digest(*a))
    one, two = (" ".join(f"w{i}" for i in range(n)) for n in (50, 53))
    assert len(sets.of(one)) == 48 and len(sets.of(two)) == 51
    assert len(hashed) == 53
    monkeypatch.setattr(ngramjoin, "REMEMBERED", 5)
    assert (ngramjoin.Sets().of(two) == sets.of(two)).all()
