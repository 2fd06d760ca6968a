"""Long repeats across documents by recompression.

Every document is rewritten in rounds: runs of one token become one symbol, then pairs
of neighbours whose classes are left and right (a bit of the symbol's name and the
round) become one. A symbol's name is the hash of what it was made of, so equal parts
get equal names everywhere without a dictionary. What a symbol is depends on a known
range of tokens only: its own and those that decided that it was not merged with its
neighbours. Two places with equal tokens in that range get equal symbols there. The hash
of this range is the key that a high-level symbol is shared by.

A window of ``window`` tokens holds the whole range of some symbol nearly always. Its key is
the smallest hash of the ranges it holds; a window that holds none has the hash of its
own tokens. So equal windows have equal keys, neighbouring windows mostly share one, and
a document has about a quarter as many keys as tokens.

Keys that documents share reveal where windows may repeat; these windows alone are then
compared by 80-bit hashes of their tokens, which verifies them. The first document with
a window, by id, keeps it. The hashes to be removed come back to the document by its id.

Defined results: words are used unchanged; null and empty texts have none; documents
with fewer words than a window lose none; rows with equal ids do not remove from each
other; rows with a null id are neither compared nor changed; repeated rows get equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.session import written

WINDOW = 13
ROUNDS = 2
#: Odd multipliers: of the token's place in a range's hash, and of the names' mixing.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PAIR = np.uint64(0xC4CEB9FE1A85EC53)


def words_of(text: pa.Buffer | None) -> list[bytes]:
    return [] if text is None else bytes(text).split()


class _Names(dict):
    """Hashes of words, as they come up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_NAMES = _Names()


def names_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_NAMES.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class Ranges:
    """Hashes of any range of a document's tokens, from prefix sums."""

    def __init__(self, names: np.ndarray, base: int) -> None:
        n = len(names)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        powers, self.down = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(names + np.uint64(base)) * powers[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def symbols(names: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that the symbols after all rounds depend on; beyond the text where its end decided."""
    n = len(names)
    begin = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if n else np.zeros(0, np.int64)
    end = np.append(begin[1:], n)
    size = (end - begin).astype(np.uint64)
    name = np.where(size > 1, _mix(names[begin] + size * _PAIR), names[begin]) if n else names
    # That a run ends where it ends is up to the tokens beside it.
    low, high = begin - 1, end + 1
    for r in range(rounds):
        right = (_mix(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        m = len(name)
        joined = np.zeros(m, bool)
        joined[:-1] = ~right[:-1] & right[1:]
        after, before = np.append(np.arange(1, m), m - 1)[:m], np.append(0, np.arange(m - 1))[:m]
        beside = np.where(right, before, after)
        new_low, new_high = np.minimum(low, low[beside]), np.maximum(high, high[beside])
        if m:  # a neighbour that is not there
            if right[0]:
                new_low[0] = -1
            if not right[-1]:
                new_high[-1] = n + 1
        name = np.where(joined, _mix(name * _PAIR + name[after]), name)
        stays = np.ones(m, bool)
        stays[1:] = ~joined[:-1]
        low, high, name = new_low[stays], new_high[stays], name[stays]
    return low, high


def keys_of(names: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """Per window its key: the smallest of the hashes of the ranges it holds, else its own."""
    n = len(names)
    if n < window:
        return np.zeros(0, np.uint64)
    low, high = symbols(names, rounds)
    fits = (low >= 0) & (high <= n) & (high - low <= window)
    low, high = low[fits], high[fits]
    first, last = np.maximum(high - window, 0), np.minimum(low, n - window)
    hashes = Ranges(names, _BASES[0])
    own, most = hashes.of(low, high), np.iinfo(np.uint64).max
    keys = np.full(n - window + 1, most)
    while len(first):
        np.minimum.at(keys, first, own)
        first = first + 1
        inside = first <= last
        first, last, own = first[inside], last[inside], own[inside]
    alone = np.flatnonzero(keys == most)
    keys[alone] = hashes.of(alone, alone + window)
    return keys


def windows_of(names: np.ndarray, window: int = WINDOW, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 80-bit hashes of all windows, or of those that begin at ``starts``: 64 bits and 16 bits."""
    starts = np.arange(max(0, len(names) - window + 1)) if starts is None else starts
    one, two = (Ranges(names, b).of(starts, starts + window) for b in _BASES)
    return one.view(np.int64), (two >> np.uint64(48)).astype(np.int16, casting="unsafe")


class Texts:
    """Several texts as one sequence, each followed by a separator that is nowhere else.

    A range that holds a separator is in no window of a text, so what is found in the
    sequence is what is found in each text.
    """

    def __init__(self, texts: list[list[bytes]], window: int) -> None:
        parts = []
        for k, words in enumerate(texts):
            parts += [names_of(words), _mix(np.array([k + 1], np.uint64) * _PAIR)]
        self.names = np.concatenate(parts)
        sizes = np.array([len(words) + 1 for words in texts])
        self.text = np.repeat(np.arange(len(texts)), sizes)
        last = np.cumsum(sizes) - 1  # the separators
        starts = np.arange(max(0, len(self.names) - window + 1))
        self.starts = starts[starts + window - 1 < last[self.text[starts]]]

    def keys(self, window: int, rounds: int) -> np.ndarray:
        """The key of each window in ``starts``."""
        return keys_of(self.names, window, rounds)[self.starts].view(np.int64)


# Spark jobs

#: Words that a task works on at a time; a longer text is taken alone.
_WORDS = 100_000


def _chunks(batches: Iterator[pa.RecordBatch], column: str, read) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows and their words, about ``_WORDS`` words at a time; of a batch only these are Python objects."""
    for batch in batches:
        at, size, texts = 0, 0, []
        for k, value in enumerate(batch[column], 1):
            texts.append(read(value.as_buffer()))
            size += len(texts[-1])
            if size >= _WORDS or k == len(batch):
                yield batch.slice(at, k - at), texts
                at, size, texts = k, 0, []


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, body``: texts compressed, so that the joins by id move less."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3)
        return pa.array([None if t is None else pack.compress(t) for t in (x.as_buffer() for x in texts)], pa.binary())

    return docs.select("doc_id", packed("text").alias("body"))


def _unpacked(body: pa.Buffer | None) -> list[bytes]:
    return [] if body is None else zstandard.ZstdDecompressor().decompress(body).split()


def _shared_keys(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """``doc_id, keys``: the keys that a document shares with one of another id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in _chunks(batches, "text", words_of):
            texts = Texts(words, window)
            keys, text = texts.keys(window, rounds), texts.text[texts.starts]
            # Neighbouring windows mostly share their key.
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])))[: len(keys)]
            yield pa.RecordBatch.from_pydict({"key": keys[new], "doc_id": rows["doc_id"].to_numpy()[text[new]]})

    rows = docs.filter("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text").mapInArrow(emit, "key long, doc_id long")
    key = Window.partitionBy("key")
    shared = rows.select("*", (F.min("doc_id").over(key) < F.max("doc_id").over(key)).alias("more")).filter("more")
    return shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _repeated(packed: DataFrame, shared: DataFrame, window: int, rounds: int) -> DataFrame:
    """``doc_id, gone``: the windows of a document that begin in one of a smaller id, too, by the first 64 bits of their hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in _chunks(batches, "body", _unpacked):
            texts = Texts(words, window)
            # A key that two documents share is in the list of each that has it.
            known = rows["keys"].flatten().to_numpy()
            starts = texts.starts[np.isin(texts.keys(window, rounds), known)]
            one, two = windows_of(texts.names, window, starts)
            frame = pd.DataFrame({"a": one, "b": two, "doc_id": rows["doc_id"].to_numpy()[texts.text[starts]]})
            yield pa.RecordBatch.from_pandas(frame.drop_duplicates(), preserve_index=False)  # a document's window once

    rows = packed.join(shared, "doc_id").select("doc_id", "body", "keys").mapInArrow(emit, "a long, b short, doc_id long")
    least = F.min("doc_id").over(Window.partitionBy("a", "b"))
    later = rows.withColumn("least", least).filter("doc_id > least").select("doc_id", "a")
    # Among the windows of one document, the first 64 bits are enough to find them again.
    return later.groupBy("doc_id").agg(F.collect_list("a").alias("gone"))


_OUT = "n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``: per row what is left, kept words joined by one space.

    ``kept`` is null where ``texts`` is false: then only the digest is made.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = written(_shared_keys(own, window, rounds), "repeat-keys")
    packed = _packed(own)
    gone = written(_repeated(packed.filter("body IS NOT NULL"), shared, window, rounds), "repeat-windows")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts_words in _chunks(batches, "body", _unpacked):
            rows = []
            for words, gone in zip(texts_words, part["gone"]):
                lost = None
                if gone.is_valid and len(words) >= window:
                    lost = _lost(words, gone.values.to_numpy(), window)
                kept = words if lost is None else [w for w, x in zip(words, lost) if not x]
                text = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text if texts else None))
            counts, gone_counts, digests, bodies = zip(*rows)
            columns = [part["doc_id"], pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(digests, pa.string())]
            kept = pa.array(bodies, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, kept], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = packed.join(gone, "doc_id", "left").select("doc_id", "body", "gone")
    return joined.mapInArrow(finish, f"doc_id long, {_OUT}")


def _lost(words: list[bytes], gone: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by a window to be removed."""
    starts = np.flatnonzero(np.isin(windows_of(names_of(words), window)[0], gone))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return np.cumsum(marks)[:-1] > 0
