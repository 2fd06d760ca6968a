"""Pieces end to end: both kinds of models against the library, the query's columns, and what is refused."""

import hashlib
import tracemalloc

import pyarrow as pa
import pytest

from sitemarks.llm import pieces
from sitemarks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _varint(value):
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def _of_kind(kind):
    """The installed model as another kind: its trainer's settings end with field 3, and the last value counts."""
    with open(pieces.default_model(), "rb") as file:
        raw = file.read()
    out = b""
    for number, value in pieces._fields(raw):
        if number == 2:
            value += b"\x18" + _varint(kind)
        assert isinstance(value, bytes)
        out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    path = tmp_path_factory.mktemp("models") / "unigram.model"
    path.write_bytes(_of_kind(1))
    return str(path)


def test_kind_is_the_models(unigram, tmp_path):
    assert pieces.load_model(pieces.default_model()).kind == "bpe"
    assert pieces.load_model(unigram).kind == "unigram"
    (tmp_path / "word.model").write_bytes(_of_kind(3))
    with pytest.raises(ValueError):
        pieces.load_model(str(tmp_path / "word.model"))


def test_unigram_model_end_to_end(spark, unigram):
    import sentencepiece

    sp, model = sentencepiece.SentencePieceProcessor(model_file=unigram), pieces.load_model(unigram)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(12).collect()]
    texts += ["日本語 😀 x\n\n  y", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    none = docs.limit(0).selectExpr("text AS word", "cast(array() AS array<int>) AS ids")
    by_task = {r.doc_id: r.ids for r in pieces.encode(docs, model, none).collect()}
    for row in pieces.decode(pieces.encode(docs, model), model).collect():
        own = None if row.text is None else [i for w in pieces._WORDS.findall(" " + row.text if row.text else "") for i in pieces.viterbi(model, w)]
        assert row.ids == by_task[row.doc_id] == own
        assert row.decoded == row.text
    total = lambda ids: sum(sp.get_score(i) for i in ids)
    for word in {w for t in texts if t for w in pieces._WORDS.findall(" " + t) if w[0] == " "}:
        # The library's path now and then is not the best by the model's own scores; ours always is.
        own, its = pieces.viterbi(model, word), sp.encode(word[1:])
        assert own == its or total(own) > total(its), word


def test_query_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_piece_lattice"](spark, SF).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = sp.encode(texts[row.doc_id])
        assert (row.n_tokens, row.lossless) == (len(ids), True)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_slices_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 5)
    import pyarrow as pa

    texts = [None, "abc", "", "defgh", None, "x" * 40, "y", None]
    assert sum(pieces._slices(pa.array(texts, pa.string())), []) == texts
    assert sum(pieces._slices(pa.array(texts, pa.string()).slice(3)), []) == texts[3:]
    assert sum(pieces._slices(pa.array([], pa.string())), []) == []


def test_marks_of_the_format_are_blanks(spark):
    docs = spark.createDataFrame([(1, "a▁b"), (2, "plain"), (3, None), (4, "")], "doc_id bigint, text string")
    model = pieces.load_model(pieces.default_model())
    got = {r.doc_id: r.tokens for r in pieces.round_trip(docs, model).collect()}
    assert [got[i].lossless for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert got[3].n_tokens is None and got[4].n_tokens == 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert {r.doc_id: r.ids for r in pieces.encode(docs, model).collect()}[1] == sp.encode("a▁b")


def test_a_batch_is_held_once():
    """Ids and decoded texts of a batch are one buffer each, not Python objects beside it."""
    model = pieces.load_model(pieces.default_model())
    own = pieces.Encoder({}, model)
    text = "naïve 漢字 \U0001f389 words\n and more, " * 40
    texts = pa.array([text, None, "", "x"] * 500)
    ids = pieces.encoded(own, texts)
    assert ids.type == pa.list_(pa.int32()) and ids.null_count == 500 and ids[3].as_py() == own.encode("x").tolist()
    tracemalloc.start()
    found = pieces.decoded(model, ids)
    size, peak = found.nbytes, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.equals(texts) and pieces.decoded(model, ids.slice(1, 3)).equals(texts.slice(1, 3))
    assert pieces.decoded(model, ids.slice(0, 0)).equals(texts.slice(0, 0)) and pieces.encoded(own, texts.slice(0, 0)).equals(ids.slice(0, 0))
    assert peak < 2 * size
