"""Two tokenizers' tokens of the same bytes, aligned by galloping intersection of their ends.

``A`` is a byte-level BPE vocabulary (a ``tokenizers`` JSON file), ``B`` a SentencePiece
model; both get a blank and the text. A's ends and B's ends are sorted lists of byte
offsets. The shorter list drives: each of its ends gallops into the longer one, by steps
that double until they pass it, and a binary search in the last step gives its rank there.
Equal ends cut the tokens into groups; the difference of two ranks is the range of tokens
that a token overlaps. All texts of a chunk are one pair of lists, their offsets one after
the other, and the searches of a chunk run side by side: every ``STRIDE``-th end from its
text's beginning, the others from the one before.

The pairs' counts over the corpus: a task collects the distinct id pairs of a block of
texts with their links, so a frequent pair is one row per block. These rows are summed,
joined with their sums, and go back to their block, where each text looks its pairs up.
Neither a table of pairs nor a text's links is ever broadcast or collected; a block is
bounded by ``BLOCK_LINKS`` and one text.

A is encoded from the file's vocabulary and merges with ``tiktoken``, which merges by
token id. That is the file's own encoding if merges are listed by the ids they make, which
is checked; other files go to ``tokenizers``, with the same result and more time.

Defined results: null and empty texts, and those whose tokens' bytes are not blank and
text (U+2581 in a text is the blank of B), have no tokens: zeros and an empty digest; strings
of special tokens are plain text; repeated rows count each; rows with null doc_id are kept;
an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.session import written

#: Characters that are tokenized and aligned at a time, and one text.
CHUNK_CHARS = 1 << 20
#: Links of a block of texts, and those of one text.
BLOCK_LINKS = 1 << 22
STRIDE = 32

#: Fixed value: the pattern of words of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Tokenizers


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: visible Latin-1 ones for themselves, then the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(other)}


class Left:
    """A: token bytes by id, and the encoding of blank and text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model, before = _byte_letters(), spec["model"], spec.get("pre_tokenizer") or {}
        vocabulary = {t: i for t, i in model["vocab"].items()}
        special = {t["content"] for t in spec.get("added_tokens", []) if t["special"]}
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(letters[c] for c in token)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocabulary[m] for m in merged]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        # Merging by id is merging by place in the list, if all but single bytes are merged in that order.
        ordered = ids == sorted(set(ids)) and len(ids) + 256 == sum(1 for b in self.bytes if b)
        words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if plain and ordered and words and not spec.get("normalizer"):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            one = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode: Callable = lambda texts: [one.encode_ordinary(t) for t in texts]
        else:
            other = Tokenizer.from_file(path)
            other.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


class Right:
    """B: piece bytes by id, and the encoding of a text, before which the model itself sets a blank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(own.get_piece_size()):
            name = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes.append(bytes([int(name[1:-1], 16)]))
            else:
                self.bytes.append(b"" if own.is_control(i) or own.is_unknown(i) else name.replace("▁", " ").encode())
        self.encode = lambda texts: own.encode(texts, num_threads=1)


def default_paths(spark: SparkSession | None = None) -> tuple[str, str]:
    """The installed vocabularies, unless ``spark.sitemarks.byteModel`` and ``spark.sitemarks.pieceModel`` name others."""
    get = lambda key: spark.conf.get(key, None) if spark else None
    return (
        get("spark.sitemarks.byteModel") or "/opt/tokenizers/byte_bpe_50k.json",
        get("spark.sitemarks.pieceModel") or "/opt/tokenizers/piece_bpe_32k.model",
    )


# Galloping


def _search(keys: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each key the first place in ``into`` that is not less, at ``start`` or later; the last of ``into`` is no less than any key."""
    low, high, step = start.copy(), start.copy(), 1
    active = np.arange(len(keys))
    while len(active):
        probe = np.minimum(low[active] + step - 1, len(into) - 1)
        less = into[probe] < keys[active]
        high[active[~less]] = probe[~less]
        active, probe = active[less], probe[less]
        low[active] = probe + 1
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = into[middle] < keys[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


def gallop(keys: np.ndarray, into: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rank of each key in ``into``; both ascend, and ``starts`` is a place at or before each key's."""
    coarse = _search(keys[::STRIDE], into, starts[::STRIDE])
    return _search(keys, into, np.maximum(np.repeat(coarse, STRIDE)[: len(keys)], starts))


def align(ends_a: np.ndarray, ends_b: np.ndarray, begin_a: np.ndarray, begin_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(last_a, last_b, left, right)`` of the ends of a chunk's texts; ``begin_*`` is the first token of each token's text in the other list.

    ``last_*``: whether a token is its group's last; ``left, right``: the tokens of each link, in order.
    """
    a_drives = len(ends_a) <= len(ends_b)
    keys, into, starts = (ends_a, ends_b, begin_a) if a_drives else (ends_b, ends_a, begin_b)
    rank = gallop(keys, into, starts)
    same = into[rank] == keys if len(keys) else np.zeros(0, bool)
    last_into = np.zeros(len(into), bool)
    last_into[rank[same]] = True
    # A token overlaps from after the last end that is not beyond its beginning to the first at or beyond its end.
    first = np.concatenate(([0], (rank + same)[:-1])) if len(keys) else rank
    counts = rank - first + 1
    key = np.repeat(np.arange(len(keys)), counts)
    other = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return (same, last_into, key, other) if a_drives else (last_into, same, other, key)


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum(sizes)
    return stop - sizes, stop


class Aligner:
    """Texts to rows; holds the tables of both tokenizers."""

    def __init__(self, left: Left, right: Right) -> None:
        self.left, self.right = left, right
        self.size_a = np.array([len(b) for b in left.bytes], np.int64)
        self.size_b = np.array([len(b) for b in right.bytes], np.int64)
        a, b = list(map(str, range(len(left.bytes)))), list(map(str, range(len(right.bytes))))
        names = [f"{x}," for x in a] + [f"{x}|" for x in a] + [f"{x}," for x in b] + [f"{x};" for x in b]
        self.names = np.array(names, object)

    def tokens(self, texts: list[str | None]) -> tuple[list, list]:
        """Per text the ids of A and B; none where they are not the bytes of blank and text."""
        given = [i for i, t in enumerate(texts) if t]
        none, a, b = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        left = self.left.encode([" " + texts[i] for i in given])
        right = self.right.encode([texts[i] for i in given])
        for i, x, y in zip(given, left, right):
            whole = (" " + texts[i]).encode("utf-8", "surrogatepass")
            if b"".join([self.left.bytes[k] for k in x]) == whole and b"".join([self.right.bytes[k] for k in y]) == whole:
                a[i], b[i] = np.array(x, np.int64), np.array(y, np.int64)
            else:
                a[i] = b[i] = none
        return a, b

    def chunk(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: tokens of A and B, groups, links, groups' digest, its distinct pairs and how many links hold each."""
        a, b = self.tokens(texts)
        na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        (a0, a1), (b0, b1) = _ranges(na), _ranges(nb)
        ids_a, ids_b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        last_a, last_b, left, right = align(
            np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), np.repeat(b0, na), np.repeat(a0, nb)
        )
        # Where each token stands when groups are written one after the other, A's tokens before B's.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        until_a, until_b = np.concatenate((np.flatnonzero(last_a) + 1, [0])), np.concatenate(([0], np.flatnonzero(last_b) + 1))
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + until_b[group_a]] = ids_a + last_a * len(self.size_a)
        code[np.arange(len(ids_b)) + until_a[group_b]] = 2 * len(self.size_a) + ids_b + last_b * len(self.size_b)
        names = self.names[code].tolist()
        pairs = ids_a[left] * len(self.size_b) + ids_b[right]
        groups = np.concatenate(([0], np.cumsum(last_a)))
        links = np.searchsorted(left, np.concatenate(([0], a1)))
        for i in range(len(texts)):
            own = "".join(names[a0[i] + b0[i] : a1[i] + b1[i]])[:-1]
            digest = hashlib.sha256(own.encode()).hexdigest() if own else ""
            found, counts = np.unique(pairs[links[i] : links[i + 1]], return_counts=True)
            yield int(na[i]), int(nb[i]), int(groups[a1[i]] - groups[a0[i]]), int(links[i + 1] - links[i]), digest, found, counts

    def groups(self, text: str) -> list[tuple[list[int], list[int]]]:
        """The groups of one text, as ids of A and B."""
        (a,), (b,) = self.tokens([text])
        zero = lambda n: np.zeros(n, np.int64)
        last_a, last_b, *_ = align(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), zero(len(a)), zero(len(b)))
        cut = lambda ids, last: [x.tolist() for x in np.split(ids, np.flatnonzero(last) + 1)[:-1]]
        return list(zip(cut(a, last_a), cut(b, last_b)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One per worker."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(Left(paths[0]), Right(paths[1]))
    return _ALIGNERS[paths]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    yield start, len(texts)


# Over the corpus

_ROW = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block bigint, pairs binary, counts binary"
_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "counts"]


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` with ``block, pairs, counts``: a text's distinct pairs, and links of each.

    A pair is A's id times the size of B's vocabulary plus B's id; pairs are 8-byte integers, counts 4-byte ones.
    Rows with null ``n_a`` hold the pairs of a whole block.
    """
    paths = tuple(paths or default_paths(docs.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, block, number, size = aligner(paths), TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in held]])
            counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in held]])
            found, where = np.unique(pairs, return_inverse=True)
            return found, np.bincount(where, counts, len(found)).astype(np.int64)

        def whole() -> pd.DataFrame:
            pairs, counts = summed()
            return pd.DataFrame([(None, None, None, None, None, None, block + number, pairs.tobytes(), counts.tobytes())], columns=_COLUMNS)

        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].tolist()
            for start, stop in _slices(texts):
                out = []
                for *numbers, pairs, counts in own.chunk(texts[start:stop]):
                    out.append((*numbers, block + number, pairs.tobytes(), counts.astype(np.uint32).tobytes()))
                    held.append((pairs, counts))
                    size += numbers[3]
                frame = pd.DataFrame(out, columns=_COLUMNS[1:])
                frame.insert(0, "doc_id", ids.iloc[start:stop].reset_index(drop=True))
                yield frame
                if size >= BLOCK_LINKS:
                    yield whole()
                    held, size, number = [], 0, number + 1
                elif len(held) > 4096:
                    held = [summed()]
        if held:
            yield whole()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInPandas(run, _ROW.format(kind=kind))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``block, pair, n`` of the blocks' rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, pairs, counts in zip(batch["block"], batch["pairs"], batch["counts"]):
                pairs, counts = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
                yield pd.DataFrame({"block": np.full(len(pairs), block), "pair": pairs, "n": counts})

    blocks = rows.filter("n_a IS NULL").select("block", "pairs", "counts")
    return blocks.mapInPandas(read, "block bigint, pair bigint, n bigint")


def cross_alignment(docs: DataFrame, paths: tuple[str, str] | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``.

    ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    ``pairs``: ``a, b, n, best``: links of each id pair, and whether no A id has more with that B id.
    """
    paths = tuple(paths or default_paths(docs.sparkSession))
    size_b = len(aligner(paths).right.bytes)
    rows = written(aligned(docs, paths, text), "align-rows")
    counted = pair_counts(rows)
    total = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    total = written(total, "align-pairs").withColumn("b", F.col("pair") % size_b)
    highest = total.groupBy("b").agg(F.max("n").alias("most"))
    judged = total.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = counted.select("block", "pair").join(judged, "pair")

    def look_up(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")
        pair, n, best = known["pair"].to_numpy(), known["n"].to_numpy(), known["best"].to_numpy(bool)
        n_best, count_sum = [], []
        for pairs, counts in zip(texts["pairs"], texts["counts"]):
            at, times = np.searchsorted(pair, np.frombuffer(pairs, np.int64)), np.frombuffer(counts, np.uint32).astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * n[at]).sum()))
        return texts.drop(columns=["block", "pairs", "counts"]).assign(n_best=n_best, count_sum=count_sum)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    texts = rows.filter("n_a IS NOT NULL")
    found = texts.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(look_up, schema)
    documents = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    pairs = judged.select(F.floor(F.col("pair") / size_b).cast("int").alias("a"), (F.col("pair") % size_b).cast("int").alias("b"), "n", "best")
    return documents, pairs
