"""Near-duplicate documents by SimHash fingerprints and Golay-code keys.

Fingerprint: words are lower-cased (A-Z), shingles of ``shingle`` words hashed by
XXH64 (seed 42), and a bit of the fingerprint is set if it is set in over half of the
hashes. Fingerprints link if at most ``max_bits`` (3 or fewer) bits differ.

Candidates: the 64 bits are cut into three segments of 21 or 22 bits, each read as a
word of the perfect binary Golay code (23 bits, 4096 codewords, radius 3). Where a
segment has at most one differing bit, one side takes the index of its nearest codeword
and the other the indices nearest to the segment and to all its one-bit changes (one
index or six): they share an index. By pigeonhole, three differing bits are either one
in each segment, and then the indices of all three are a key; or some segment has none
and another at most one, and then the one segment's bits and the other's index are a
key, for each choice of the two. Keys have 33 bits or more, so few of them are shared by
chance. Equal keys are compared bit by bit.

Only distinct fingerprints are compared; copies meet in an aggregation before. Links
inside one key are found block against block and leave as a forest, at most one row
per member and block, never as all pairs.

Defined results: null or blank texts have fingerprint zero and link like any other;
fewer words than a shingle are one shingle; repeated rows get equal results; an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemarks.llm.components import components
from sitemarks.session import written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Members of a key that one task compares with each other at a time.
BLOCK = 2048

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GENERATOR = 0b101011100011
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: A segment without a differing bit, and one with at most one.
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at a time, so that very long texts need no more memory.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(first), _CHUNK):
        hashes = b"".join([digest(flat[s:e], SEED) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    value = np.packbits((2 * ones > len(first)).astype(np.uint8)).tobytes()
    return int.from_bytes(value, "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """Add the fingerprint as a (signed) long; the hexadecimal form is ``hex_digits``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def hex_digits(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


class Golay:
    """Nearest codewords of 23-bit words: by syndrome, from all error patterns of up to three bits."""

    def __init__(self) -> None:
        powers = [self._rest(1 << i) for i in range(23)]
        self.syndromes = np.array(powers, np.int64)
        self.errors = np.zeros(2048, np.int64)
        patterns = [0]
        for bits in range(3):
            patterns = sorted({p | 1 << i for p in patterns for i in range(23)} | set(patterns))
        for p in patterns:
            s = 0
            for i in range(23):
                if p >> i & 1:
                    s ^= powers[i]
            self.errors[s] = p

    @staticmethod
    def _rest(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of each word's nearest codeword: its upper bits, as the code is systematic."""
        s = np.zeros_like(words)
        for i in range(23):
            s ^= np.where(words >> i & 1, self.syndromes[i], 0)
        return (words ^ self.errors[s]) >> 11

    def indices(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Per word the indices nearest to it and to its one-bit changes in the lowest ``bits``."""
        return np.stack([self.index(words), *[self.index(words ^ (1 << i)) for i in range(bits)]], axis=1)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    bits, at, out = fps.view(np.uint64), 0, []
    for n in SEGMENTS:
        out.append((bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    return out


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[list[list[int]], list[list[int]]]:
    """Per fingerprint the keys it is stored under and those it asks for."""
    cut = _segments(fps)
    near = [[sorted(set(row)) for row in golay.indices(c, n).tolist()] for c, n in zip(cut, SEGMENTS)]
    one, raw = [golay.index(c).tolist() for c in cut], [c.tolist() for c in cut]
    stored, asked = [], []
    for row in range(len(fps)):
        (a, b, c), (na, nb, nc) = (x[row] for x in one), (x[row] for x in near)
        kept = [x << 24 | b << 12 | c for x in na]
        sought = [a << 24 | y << 12 | z for y in nb for z in nc]
        for k, (same, other) in enumerate(PAIRS, 1):
            head = k << 48 | raw[same][row] << 12
            kept.append(head | one[other][row])
            sought += [head | z for z in near[other][row]]
        stored.append(kept)
        asked.append(sought)
    return stored, asked


def _with_keys(fps: DataFrame) -> DataFrame:
    """``key, fp, side`` for distinct fingerprints; side 1 is stored, 2 asks, 3 does both."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                stored, asked = keys_of(part, golay)
                rows: dict[tuple[int, int], int] = {}
                for fp, s, a in zip(part.tolist(), stored, asked):
                    for k in s:
                        rows[k, fp] = 1
                    for k in a:
                        rows[k, fp] = rows.get((k, fp), 0) | 2
                key, fp = zip(*rows) if rows else ((), ())
                yield pd.DataFrame({"key": np.array(key, np.int64), "fp": np.array(fp, np.int64), "side": np.array(list(rows.values()), np.int8)})

    # A fingerprint becomes about seventy rows, so few bytes are much work: no coalescing here.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.select("fp").repartition(parts, "fp").mapInPandas(split, "key long, fp long, side byte")


def forest(own: np.ndarray, other: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what links of at most ``max_bits`` between two blocks connect."""
    nodes = np.unique(np.concatenate([own, other]))
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at, links = np.searchsorted(nodes, other), []
    for i, fp in zip(np.searchsorted(nodes, own).tolist(), own):
        near = at[np.bitwise_count((other ^ fp).view(np.uint64)) <= max_bits]
        for j in np.unique(root[near]).tolist():
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((i, j))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def _links(fps: DataFrame, max_bits: int, block: int) -> DataFrame:
    """``a, b`` connecting all distinct fingerprints that links connect.

    Keys with few members are joined; a key with many is cut into blocks, and each two
    blocks are compared in a task of their own.
    """
    keyed = written(_with_keys(fps), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("side").alias("sides"))
    busy = sizes.filter("n > 1 AND sides = 3")
    small, large = busy.filter(F.col("n") <= F.lit(64)), busy.filter(F.col("n") > F.lit(64))
    few = keyed.join(small.select("key"), "key", "left_semi")
    stored = few.filter("side & 1 = 1").select("key", F.col("fp").alias("a"))
    asking = few.filter("side & 2 = 2").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    plain = stored.join(asking, "key").filter(near & (F.col("a") != F.col("b"))).select("a", "b")

    blocks = F.ceil(F.col("n") / block).cast("int")
    many = keyed.join(large.select("key", blocks.alias("blocks")), "key").select(
        "key", "fp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("own")
    )
    # A member of block i goes to the tasks (i, j) of all blocks j, in the order of the two.
    spread = many.select(
        "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    ).select("key", "fp", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, i, j = group["fp"].to_numpy(np.int64), group["i"].iloc[0], group["j"].iloc[0]
        first, second = fp[group["own"] == i], fp[group["own"] == j]
        a, b = forest(first, second, max_bits)
        return pd.DataFrame({"a": a, "b": b})

    dense = spread.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    return plain.unionByName(dense)


def classes(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``fp, root`` of each distinct value of ``fp``: the fingerprints reachable from each other."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the segments answer for at most three differing bits")
    nodes = fps.select("fp").filter("fp IS NOT NULL").distinct()
    linked = components(_links(nodes, max_bits, block))
    return nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row.

    ``component_id`` is the smallest id in the row's component; null ids are never
    the smallest, and a component without any id has none.
    """
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = written(with_fingerprints(ids, "text", shingle).select("doc_id", "fp"), "fingerprints")
    # Copies are reduced to one row per fingerprint before anything is joined.
    least = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    root = written(classes(least, max_bits).join(least, "fp"), "fingerprints")
    named = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = root.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays: the one with the smallest ``doc_id``.

    Of rows that share this id, the one with the smallest hash of its text stays. Rows
    without an id stay.
    """
    found = written(near_duplicates(docs, "doc_id", "text", shingle, max_bits), "components")
    ids = found.filter("doc_id = component_id").select("doc_id", "fp")
    kept = docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    twice = written(repeated.select("doc_id"), "components")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = kept.join(twice, "doc_id", "left_semi").select(
        F.col("doc_id").alias("_llm_id"), F.col("text").alias("_llm_text"), F.struct(*columns).alias("_llm_row")
    )
    # Rows that share the id: only those of the component it names may stay.
    own = with_fingerprints(rows, "_llm_text", shingle, "_llm_fp").join(
        ids.distinct(), (F.col("_llm_id") == F.col("doc_id")) & (F.col("_llm_fp") == F.col("fp")), "left_semi"
    )
    first = F.min(F.struct(F.xxhash64("_llm_text").alias("h"), F.col("_llm_row").alias("row")))
    one = own.groupBy("_llm_id").agg(first.alias("s")).select("s.row.*")
    single = kept.join(twice, "doc_id", "left_anti").select(*columns)
    return single.unionByName(one).unionByName(docs.filter("doc_id IS NULL"))
