"""Every stage of the pipeline against brute force on what the stage before left, and ``run`` as all of them."""

import re

import corpus_pipeline
import pytest
import xxhash
from compare import oracle_rows
from test_lines import _windows

from sitemarks.llm import lines, pieces
from sitemarks.llm.queries import ORACLES
from sitemarks.session import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Per stage its name, its input and its output, as rows by id."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, kept))
        docs = kept
    return {name: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}, a) for name, a, b in out}


def test_columns_and_flow(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    for before, after in zip(names, names[1:]):
        assert stages[before][1] == stages[after][0]
    for name in names[:-1]:
        assert {tuple(r.__fields__) for r in stages[name][1].values()} == {("doc_id", "text", "lang", "source", "n_chars")}


def test_quality_rules(stages):
    before, after, _ = stages["quality_rules"]
    names, rows = oracle_rows(ORACLES["op4_quality_rules"], SF)
    kept = {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    assert after == {i: r for i, r in before.items() if i in kept}
    assert 0 < len(after) < len(before)


def test_line_dedup(stages):
    before, after, _ = stages["line_dedup"]
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(" \t\n\x0b\f\r")).lower()
    places = [(i, k, plain(x)) for i in sorted(before) for k, x in enumerate(before[i].text.split("\n"))]
    texts = sorted({p[2] for p in places if p[2]}, key=len)
    sets, root = {x: _windows(x) for x in texts}, {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(texts):
        for b in texts[n + 1 :]:
            if len(sets[b]) * lines.SIMILARITY > len(b):  # sets are no larger than their lines
                break
            if min(len(sets[a]), len(sets[b])) >= lines.SIMILARITY * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if shared >= lines.SIMILARITY * (len(sets[a]) + len(sets[b]) - shared):
                    root[find(a)] = find(b)
    # A longer line can still be similar to a shorter one whose windows repeat: all pairs by size of the sets.
    by_size = sorted(texts, key=lambda x: len(sets[x]))
    for n, a in enumerate(by_size):
        for b in by_size[n + 1 :]:
            if len(sets[b]) * lines.SIMILARITY > len(sets[a]):
                break
            shared = len(sets[a] & sets[b])
            if shared >= lines.SIMILARITY * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    seen, left = set(), {}
    for i, k, x in places:
        if not x or find(x) not in seen:
            left.setdefault(i, []).append(k)
        if x:
            seen.add(find(x))
    for i, r in before.items():
        own = r.text.split("\n")
        text = "\n".join(own[k] for k in left.get(i, []))
        assert (i in after) == bool(WORD.search(text))
        if i in after:
            assert after[i].text == text
    assert any(after[i].text != before[i].text for i in after)


def _fingerprint(text):
    words = WORD.findall(text.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    if not words:
        return 0
    own = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    prints = {i: _fingerprint(r.text) for i, r in before.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert after == {i: r for i, r in before.items() if find(i) == i}


def test_decontamination(stages, tmp_path):
    before, after, frame = stages["decontamination"]
    frame.toPandas().to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "benchmark.parquet").symlink_to(f"{SF}/benchmark.parquet")
    names, rows = oracle_rows(ORACLES["op8_benchmark_automaton"], str(tmp_path))
    found = {r[names.index("doc_id")]: (r[names.index("n_hit")], r[names.index("contaminated")]) for r in rows}
    assert set(after) == {i for i, (_, bad) in found.items() if not bad}
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    count = lambda t: len(words.findall(t.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    for i, r in after.items():
        hits = found[i][0]
        assert count(r.text) == count(before[i].text) - hits
        assert hits or r.text == before[i].text


def test_tokens(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    before, after, _ = stages["tokens"]
    assert set(after) == set(before)
    for i, r in after.items():
        assert r.ids == sp.encode(before[i].text) and r.lossless


def test_run_is_all_stages(spark, stages):
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()} == stages["tokens"][1]


def test_odd_rows_through_all_stages(spark):
    words = " ".join(f"word{i} and other{i}" for i in range(40))
    rows = [(1, words), (1, words), (None, words + " x"), (2, None), (3, ""), (4, " \n"), (5, words.upper()), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'l' AS lang", "1 AS ids", "2 AS fp", "3 AS n_words")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"odd-{name}")
        assert out.columns == docs.columns + (["lossless"] if name == "tokens" else [])
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "quality_rules":
            assert {r.text for r in out.collect()} == {words, words + " x"}  # the third fails by its capitals
            docs = out
    assert out.count() >= 1
