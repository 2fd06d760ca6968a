"""SentencePiece encoding and decoding over a relational lattice.

The corpus' words (a word is a run of blanks with what follows it, or a line break) are
counted, and the most frequent are encoded relationally: their substrings of bounded
length are exploded, joined with the piece table, grouped into one lattice per word,
and folded with ``aggregate``. Two folds are there: ``unigram``, the Viterbi path of the
largest total score, and ``bpe``, which replays the merges in the order of their scores.
A BPE model's scores are ranks; only the second fold gives that model's own encoding,
so it is used for such models.

The code table of the frequent words has at most ``vocabulary`` rows, whatever the
corpus, and is broadcast; texts are then encoded where they are, so no text and no
token is ever shuffled. Words outside the table go through the same fold, as a function
over the same pieces, in the task that meets them.

Only models with identity normalisation, dummy prefix and byte fallback are taken;
others are refused. Pieces are checked not to reach over a word's end.

Defined results: a null text has null ids, an empty one none; decoding gives the text
back, except that U+2581 in a text comes back as a blank, as the format cannot tell
them apart; repeated rows, long texts and long words are encoded like any other; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.session import written

BLANK = "▁"
#: Rows of the broadcast code table, at most.
VOCABULARY = 1 << 18
#: Words in the code table are no longer than this; longer ones are encoded in their task.
LONGEST_WORD = 64
#: Pieces of a model, at most; the piece table is broadcast.
MOST_PIECES = 1 << 20
#: Words outside the table that a Python worker remembers.
REMEMBERED = 1 << 16

#: Characters of the texts that a task encodes at a time, and one text.
SLICE = 1 << 20

_WORD = r"\n| +[^ \n]*|[^ \n]+"
_WORDS = re.compile(_WORD)


@dataclass(frozen=True)
class Model:
    """A SentencePiece model: ``pieces`` maps text (blanks as they are) to (score, id)."""

    kind: str
    pieces: dict[str, tuple[float, int]]
    first_byte: int
    texts: list[bytes]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def penalty(self) -> float:
        """The score of a character without a piece, in a unigram model."""
        return min((s for s, _ in self.pieces.values()), default=0.0) - 10


def _fields(raw: bytes):
    """(number, value) of a message's fields, as its wire format has them."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + size]
            at += size


def model_kind(path: str) -> str:
    """What a model file says it is: field 3 of its trainer's settings, which are field 2. Other kinds are refused."""
    with open(path, "rb") as file:
        settings = dict(_fields(file.read())).get(2, b"")
    kind = {1: "unigram", 2: "bpe"}.get(dict(_fields(settings)).get(3, 1))
    if not kind:
        raise ValueError("only unigram and BPE models are taken")
    return kind


def load_model(path: str) -> Model:
    import sentencepiece

    kind = model_kind(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    if size > MOST_PIECES:
        raise ValueError(f"{size} pieces; the piece table may have {MOST_PIECES}")
    pieces, texts, first_byte = {}, [], -1
    for i in range(size):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(name[1:-1], 16)
            first_byte = i if value == 0 else first_byte
            texts.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"")
        else:
            text = name.replace(BLANK, " ")
            pieces[text] = (sp.get_score(i), i)
            texts.append(text.encode())
    model = Model(kind, pieces, first_byte, texts)
    check(model)
    probe = "Ａ  ﬁ x\n y "
    if decode_ids(model, sp.encode(probe)) != probe:
        raise ValueError("the model normalises texts; only identity normalisation is taken")
    return model


def check(model: Model) -> None:
    if model.first_byte < 0:
        raise ValueError("the model has no byte fallback")
    crossing = [p for p in model.pieces if len(_WORDS.findall(p)) > 1]
    if crossing:
        raise ValueError(f"pieces reach over a word's end: {crossing[:5]}")


def decode_ids(model: Model, ids) -> str:
    raw = b"".join([model.texts[i] for i in ids])
    return raw.decode("utf-8", "replace").removeprefix(" ")


# The relational lattice


def _edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``word, edges``: per word the pieces in it, as (start, end, score, id)."""
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    parts = starts.select(
        "word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s") + 1))).alias("n")
    ).select("word", "s", "n", F.expr("substring(word, s, n)").alias("piece"))
    # The piece table's size is checked when the model is loaded.
    found = parts.join(F.broadcast(pieces), "piece").select(
        "word", F.struct((F.col("s") - 1).alias("s"), (F.col("s") + F.col("n") - 1).alias("e"), "score", "id").alias("edge")
    )
    lattice = found.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    none = "cast(array() as array<struct<s:int,e:int,score:double,id:int>>)"
    return words.select("word").join(lattice, "word", "left").select("word", F.coalesce("edges", F.expr(none)).alias("edges"))


#: Boundaries of a word's pieces after all merges: the best edge over two neighbours first, then the leftmost.
_BPE_FOLD = """aggregate(sequence(1, length(word)), sequence(0, length(word)), (b, k) ->
    transform(array(array_min(transform(
        filter(edges, e -> array_position(b, e.s) > 0 and get(b, cast(array_position(b, e.s) + 1 as int)) = e.e),
        e -> named_struct('r', -e.score, 's', e.s, 'e', e.e)))),
      m -> if(m is null, b, filter(b, x -> x <= m.s or x >= m.e)))[0])"""

#: The Viterbi path: per position the best total, and where the last piece began (negated: of equal totals, the earliest).
#: Characters without a piece cost ``penalty``.
_VITERBI = """aggregate(sequence(1, length(word)), array(named_struct('t', 0.0D, 's', 1)), (p, j) ->
    concat(p, array(array_max(concat(
      array(named_struct('t', p[j - 1].t + {penalty}D, 's', 1 - j)),
      transform(filter(edges, e -> e.e = j), e -> named_struct('t', p[e.s].t + e.score, 's', -e.s)))))))"""
_PATH = """aggregate(sequence(1, length(word)), array(length(word)), (b, k) ->
    if(b[0] = 0, b, concat(array(-path[b[0]].s), b)))"""


def lattice_codes(words: DataFrame, model: Model) -> DataFrame:
    """``word, ids`` of distinct words, by the lattice. Blanks in words are blanks."""
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, float(s), i) for p, (s, i) in model.pieces.items()], "piece string, score double, id int")
    lattice = _edges(words, pieces, model.longest)
    if model.kind == "bpe":
        cut = lattice.select("word", "edges", F.expr(_BPE_FOLD).alias("bounds"))
    else:
        best = lattice.select("word", "edges", F.expr(_VITERBI.format(penalty=model.penalty)).alias("path"))
        cut = best.select("word", "edges", F.expr(_PATH).alias("bounds"))
    # A character without a piece becomes its UTF-8 bytes.
    of_bytes = f"""transform(sequence(1, octet_length(t)), k ->
        cast(conv(substring(hex(encode(t, 'UTF-8')), 2 * k - 1, 2), 16, 10) as int) + {model.first_byte})"""
    ids = f"""flatten(transform(sequence(0, size(bounds) - 2), i ->
        transform(array(filter(edges, e -> e.s = bounds[i] and e.e = bounds[i + 1])), f ->
          if(size(f) > 0, array(f[0].id),
             transform(array(substring(word, bounds[i] + 1, bounds[i + 1] - bounds[i])), t -> {of_bytes})[0]))[0]))"""
    return cut.select("word", F.expr(ids).alias("ids"))


# Words outside the code table: the same folds as functions


def _as_ids(model: Model, parts: list[str]) -> list[int]:
    ids: list[int] = []
    for part in parts:
        if part in model.pieces:
            ids.append(model.pieces[part][1])
        else:
            ids += [model.first_byte + b for b in part.encode("utf-8", "surrogatepass")]
    return ids


def merge(model: Model, word: str) -> list[int]:
    """BPE: neighbours with the best score become one, until no two neighbours form a piece."""
    pieces, part = model.pieces, list(word)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = []
    for i in range(len(part) - 1):
        both = part[i] + part[i + 1]
        if both in pieces:
            heap.append((-pieces[both][0], i, both))
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] else len(part)
        if j >= len(part) or part[i] + part[j] != both:
            continue  # one of the two has merged with another meanwhile
        part[i], part[j], after[i] = both, "", after[j]
        if after[j] < len(part):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(part):
                new = part[left] + part[right]
                if new in pieces:
                    heapq.heappush(heap, (-pieces[new][0], left, new))
    return _as_ids(model, [p for p in part if p])


def viterbi(model: Model, word: str) -> list[int]:
    """Unigram: the pieces of the largest total score; of equal ones, the earliest beginning of the last piece."""
    penalty = model.penalty
    best: list[tuple[float, int]] = [(0.0, 1)]
    for j in range(1, len(word) + 1):
        own = [(best[j - 1][0] + penalty, 1 - j)]
        for s in range(max(0, j - model.longest), j):
            if word[s:j] in model.pieces:
                own.append((best[s][0] + model.pieces[word[s:j]][0], -s))
        best.append(max(own))
    parts, j = [], len(word)
    while j:
        parts.append(word[-best[j][1] : j])
        j = -best[j][1]
    return _as_ids(model, parts[::-1])


# Corpus and texts


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts; counts grow with the corpus and are combined before the shuffle."""
    marked = F.concat(F.lit(" "), F.translate(text, BLANK, " "))
    words = F.regexp_extract_all(marked, F.lit(_WORD), F.lit(0))
    # Not explode: Spark would filter on the size first, which splits every text twice.
    own = docs.filter(F.length(text) > 0).select(F.explode_outer(words).alias("word"))
    return own.groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(counts: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """The words at or above the smallest count that leaves at most ``most`` of them."""
    short = counts.filter(F.length("word") <= LONGEST_WORD)
    least, total = None, 0
    # Different counts are few: a corpus of N words has at most sqrt(2 N).
    for row in short.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    return short.filter(F.lit(False)) if least is None else short.filter(F.col("n") >= least)


def code_table(docs: DataFrame, model: Model, most: int = VOCABULARY, text: str = "text") -> DataFrame:
    """``word, ids`` of the corpus' frequent words, at most ``most`` rows."""
    counts = written(word_counts(docs, text), "word-counts")
    return written(lattice_codes(frequent_words(counts, most).select("word"), model), "word-codes")


def _slices(texts: pa.Array):
    """Slices of a batch of about ``SLICE`` characters: one is decoded to Python strings at a time."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= SLICE:
            yield texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    yield texts.slice(start).to_pylist()


def encoded(own: Encoder, texts: pa.Array) -> pa.Array:
    """The ids of a batch's texts, in one buffer that grows and that the result takes over: they are there once."""
    ends, values = [0], bytearray()
    for part in _slices(texts):
        for t in part:
            if t is not None:
                values += own.encode(t).tobytes()
            ends.append(len(values) // 4)
    ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids, mask=texts.is_null())


def decoded(model: Model, rows: pa.Array) -> pa.Array:
    """The texts of a batch's ids, as ``encoded`` in one buffer, not as Python strings beside it."""
    ends, values, at, valid = [0], bytearray(), rows.offsets.to_pylist(), rows.is_valid()
    for i, known in enumerate(valid.to_pylist()):
        if known:
            values += decode_ids(model, rows.values[at[i] : at[i + 1]].to_pylist()).encode()
        ends.append(len(values))
    bits = np.packbits(valid.to_numpy(zero_copy_only=False), bitorder="little").tobytes()
    buffers = [pa.py_buffer(bits), pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(values)]
    return pa.Array.from_buffers(pa.string(), len(rows), buffers)


def encode(docs: DataFrame, model: Model, codes: DataFrame | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of a text, as an array of ints."""
    table = _broadcast(docs, model, codes, text)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return encoded(table.value, texts)

    return docs.withColumn(out, of(F.col(text)))


def round_trip(docs: DataFrame, model: Model, codes: DataFrame | None = None, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``n_tokens``, the SHA-256 of the ids (decimal, comma-joined), and whether they decode to the text, as one struct.

    Null texts have null tokens and digest; they are lossless.
    """
    table = _broadcast(docs, model, codes, text)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,lossless:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        own, out = table.value, []
        raw, names = own.model.texts, list(map(str, range(len(own.model.texts))))
        for part in _slices(texts):
            for t in part:
                if t is None:
                    out.append({"n_tokens": None, "ids_sha256": None, "lossless": True})
                    continue
                ids = own.encode(t).tolist()
                digest = hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest()
                same = b"".join([raw[i] for i in ids]) == (b" " + t.encode("utf-8", "surrogatepass") if t else b"")
                out.append({"n_tokens": len(ids), "ids_sha256": digest, "lossless": same})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("lossless", pa.bool_())]))

    return docs.withColumn(out, of(F.col(text)))


class Encoder:
    """What a task needs to encode texts: the code table, the model, and words it has met, a bounded number."""

    def __init__(self, known: dict[str, bytes], model: Model) -> None:
        self.known, self.model, self.met = known, model, {}

    def __getstate__(self):
        return self.known, self.model

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def word(self, word: str) -> bytes:
        ids = self.met.get(word)
        if ids is None:
            fold = merge if self.model.kind == "bpe" else viterbi
            ids = np.array(fold(self.model, word), np.int32).tobytes()
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            if len(word) <= LONGEST_WORD:
                self.met[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        known, other = self.known, self.word
        words = _WORDS.findall(" " + text.replace(BLANK, " ")) if text else ()
        return np.frombuffer(b"".join([known.get(w) or other(w) for w in words]), np.int32)


def _broadcast(docs: DataFrame, model: Model, codes: DataFrame | None, text: str):
    """The encoder with a code table of at most ``VOCABULARY`` words, unless one is given."""
    codes = code_table(docs, model, text=text) if codes is None else codes
    known = {row["word"]: np.array(row["ids"], np.int32).tobytes() for row in codes.toLocalIterator()}
    return docs.sparkSession.sparkContext.broadcast(Encoder(known, model))


def decode(df: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of token ids; control pieces are nothing, broken UTF-8 is replaced."""
    table = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        return decoded(table.value, rows)

    return df.withColumn(out, of(F.col(ids)))


def default_model(spark: SparkSession | None = None) -> str:
    """The path of the installed model, unless ``spark.sitemarks.pieceModel`` names another."""
    configured = spark.conf.get("spark.sitemarks.pieceModel", None) if spark else None
    return configured or "/opt/tokenizers/piece_bpe_32k.model"
