"""Alignment against the libraries' own tokens and all pairs of their byte ranges."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sitemarks.llm import alignment
from sitemarks.llm.queries import QUERIES

PATHS = alignment.default_paths()
TEXTS = [
    "Hello world, hello tokens", "", None, " ", "\n\n  x  \n", "café naïve \U0001f389\U0001f1e9\U0001f1ea é", "▁odd▁",
    "<|endoftext|> <s> </s> <unk> <0x41>", "中文字符 mixed русский", "a" * 5000, "x " * 3000,
    "tab\there\r\nand\x0b\x0c\x00nul", "don't we'll I'M 12345678 3.14159", "  wide　", "ﬁ Ａ ２", "Hello world, hello tokens",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = alignment._byte_letters()
    a_bytes = lambda i: bytes(letters[c] for c in one.id_to_token(i))
    b_bytes = lambda i: bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        whole = (" " + text).encode()
        ab, bb = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        return (list(zip(a, ab)), list(zip(b, bb))) if b"".join(ab) == whole == b"".join(bb) else ([], [])

    return one, tokens


def brute(rows, tokens):
    every, out = Counter(), []
    for doc, text in rows:
        a, b = tokens(text)
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        links = []
        starts = [s for _, s, _ in spans[1]]
        for i, s, e in spans[0]:
            for j, s2, e2 in spans[1][max(0, bisect.bisect_right(starts, s) - 1) :]:
                if s2 >= e:
                    break
                if e2 > s:
                    links.append((i, j))
        both = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        groups, pa, pb = [], 0, 0
        for end in sorted(both):
            ga = [i for i, s, e in spans[0] if pa < e <= end]
            gb = [i for i, s, e in spans[1] if pb < e <= end]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            pa = pb = end
        every.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), links, digest))
    most = Counter()
    for (i, j), n in every.items():
        most[j] = max(most[j], n)
    result = [(d, na, nb, g, len(ls), sum(every[x] == most[x[1]] for x in ls), sum(every[x] for x in ls), h) for d, na, nb, g, ls, h in out]
    return sorted(result, key=str), every, most


def _slow(texts):
    return [t if t is None or len(t) < 1200 else t[:1200] for t in texts]


def test_bytes_are_encoded_as_by_the_file(libraries):
    one, _ = libraries
    left = alignment.aligner(PATHS).left
    r = random.Random(3)
    words = [one.id_to_token(i) for i in range(50256)]
    letters = alignment._byte_letters()
    texts = ["".join(map(chr, range(k, k + 64))) for k in [*range(0, 0xD800, 64), *range(0xE000, 0x30000, 64)]]
    texts += [bytes(letters[c] for w in r.choices(words, k=12) for c in w).decode("utf-8", "replace") for _ in range(5000)]
    texts += [bytes(letters[c] for c in w).decode("utf-8", "replace") for w in words]
    assert left.encode(texts) == [e.ids for e in one.encode_batch(texts, add_special_tokens=False)]


def test_other_files_take_the_other_library(tmp_path):
    import json

    with open(PATHS[0], encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"] = spec["model"]["merges"][:1000][::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert alignment.Left(str(path)).encode(["the cat <|endoftext|>"]) != alignment.Left(PATHS[0]).encode(["the cat <|endoftext|>"])


def test_gallop():
    r = np.random.default_rng(1)
    for _ in range(300):
        into = np.unique(r.integers(0, 2000, r.integers(1, 400)))
        keys = np.unique(r.integers(0, into[-1] + 1, r.integers(1, 400)))
        right = np.searchsorted(into, keys)
        assert (alignment.gallop(keys, into, np.zeros(len(keys), np.int64)) == right).all()
        assert (alignment.gallop(keys, into, (right * r.random(len(keys))).astype(np.int64)) == right).all()


@pytest.mark.parametrize("block, chunk", [(1, 1), (500, 100), (1 << 22, 1 << 20)])
def test_equals_all_pairs_of_ranges(spark, libraries, monkeypatch, block, chunk):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(_slow(TEXTS))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS pair")
    documents, pairs = alignment.cross_alignment(frame)
    expected, every, most = brute(rows, libraries[1])
    assert sorted(map(tuple, documents.collect()), key=str) == expected
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in every.items()}


def test_groups_join_to_the_text():
    own = alignment.aligner(PATHS)
    for text in TEXTS:
        if text and "▁" not in text:
            groups = own.groups(text)
            for k, side in enumerate((own.left, own.right)):
                assert b"".join(side.bytes[i] for g in groups for i in g[k]).decode() == " " + text
            assert all(b"".join(own.left.bytes[i] for i in a) == b"".join(own.right.bytes[i] for i in b) for a, b in groups)
    assert own.groups("") == [] and own.groups("▁odd▁") == []


def test_empty_table(spark):
    documents, pairs = alignment.cross_alignment(spark.createDataFrame([], "doc_id bigint, text string"))
    assert documents.collect() == [] and pairs.collect() == []


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_token_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, libraries[1])[0]
