"""Documents whose shingle sets are similar: a grouped prefix join.

A document's set holds its distinct shingles of ``shingle`` words (A-Z lower-cased); with
fewer words, all of them are one shingle; without words it is empty. Two documents link
when ``100 * |intersection| >= percent * |union|``. Components are those of all links.

Method:
1. Equal sets are one class; only its smallest doc_id, its representative, goes on.
2. Shingles have one order for all documents: shingles that are not frequent first, by
   hash, then frequent ones by their count. Any order gives right results; this one keeps
   what many documents share out of the prefixes. Counts cover all documents: a shingle
   counts in a task's chunk from ``LOCAL`` documents on, so what is in over one of some
   thousand documents is found; at most ``MOST``, by a threshold, go to all tasks.
3. A set's first shingles are its prefix; similar sets have a common shingle in theirs.
   Documents with equal prefix and size are one group, and groups meet by shingle.
4. Group pairs are filtered by size, by the position of the common shingle, and by what
   the two prefixes as wholes still allow. None of these loses a link.
5. What is left is expanded to members, and their whole sets are compared.

No list of a shingle's groups is paired as a whole at once. First each list, and each
group, is compared with one member, its centre, for ``ROUNDS`` rounds. While large components
then still meet in lists, these are compared with several centres of other components. Then pairs
that lie in different components so far are all compared: rows of a list meet by the components
that the list holds, so a family of near copies is one entry there, however large.

Shingles and sets are compared by 64-bit hashes of their words and 128-bit digests. With
one seed per number of words, a false equality in a pair of sets of n has odds of n^2 / 2^64.

Defined results: null texts and texts without words have empty sets, which link with
nothing; rows with equal doc_id are one document, linked if one of its texts is; a null
doc_id is a document and the smallest of its component; an empty table gives empty
tables; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.llm.components import components
from sitemarks.session import written

SHINGLE = 3
PERCENT = 90
ROUNDS = 4
#: Further rounds, of as many centres a list and twice as many each time, while large components meet in lists.
CENTRE_ROUNDS, CENTRES = 4, 32
#: Documents of a chunk that hold a shingle, from which on it is counted.
LOCAL = 2
#: A chunk: so many documents, or shingles.
CHUNK_DOCS, CHUNK_SHINGLES = 8192, 1 << 22
#: Frequent shingles that go to all tasks, at most (16 bytes each).
MOST = 1 << 18
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 20

_NULL_ID = -(2**63)


class Met(dict):
    """Hashes of words that a worker has met; a new one is hashed when it is looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Sets:
    """Shingle sets as sorted arrays of 64-bit hashes."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle, self.met = shingle, Met()

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        one = np.fromiter(map(self.met.__getitem__, words), np.uint64, len(words))
        size = len(one) - self.shingle + 1
        out = np.zeros(size, np.uint64)
        for k in range(self.shingle):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + size]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _digest(*parts: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(b"".join(parts))
    return _signed(value >> 64), _signed(value & (1 << 64) - 1)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set that must meet the other's, if that is no larger."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _index_size(n: Column, percent: int) -> Column:
    """The same for the smaller of two sets, which needs fewer."""
    return n - F.ceil(2 * percent * n / (100 + percent)) + 1


class Order:
    """The order of all shingles: frequent ones last, by count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def ranks(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingles, self.counts[at], 0)

    def prefix(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        return shingles[np.lexsort((shingles, self.ranks(shingles)))][: prefix_size(len(shingles), percent)]

    def may_link(self, a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
        """Whether two prefixes allow a link: up to where the shorter one ends, what only one of them has is in that set only."""
        both = np.concatenate((a, b))
        ranks = self.ranks(both)
        order = np.lexsort((both, ranks))
        sorted_ = both[order]
        again = np.flatnonzero(sorted_[1:] == sorted_[:-1])
        alone = np.ones(len(both), bool)
        alone[again] = alone[again + 1] = False
        place = np.empty(len(both), np.int64)
        place[order] = np.arange(len(both))
        end = min(place[len(a) - 1], place[-1])
        # The common shingle where a prefix ends may stand at one place or the next.
        left = alone[: end + 1] & (order[: end + 1] < len(a))
        right = alone[: end + 1] & (order[: end + 1] >= len(a))
        need = percent * (na + nb)
        return (100 + percent) * min(na - int(left.sum()), nb - int(right.sum())) >= need


# Passes over texts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), "text")


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the frequent shingles of all documents, at most ``MOST``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, chunk, size = Sets(shingle), {}, 0

        def counted() -> pd.DataFrame:
            every = np.concatenate([*chunk.values(), np.zeros(0, np.uint64)])
            hashes, counts = np.unique(every, return_counts=True)
            often = counts >= LOCAL
            return pd.DataFrame({"hash": hashes[often].view(np.int64), "n": counts[often].astype(np.int64)})

        for batch in batches:
            for text in batch["text"]:
                own = sets.of(text)
                chunk.setdefault(xxhash.xxh3_128_digest(own.tobytes()), own)
                size += len(own)
                if len(chunk) >= CHUNK_DOCS or size >= CHUNK_SHINGLES:
                    yield counted()
                    chunk, size = {}, 0
        yield counted()

    found = docs.select("text").mapInPandas(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    found = written(found, "join-frequent")
    # The threshold is a power of two; there are at most 63.
    levels = found.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()
    least, total = 63, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["n"]
        if total > MOST:
            break
        least = row["level"]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hashes": [batch["hash"].to_numpy(np.int64).tobytes()], "counts": [batch["n"].to_numpy(np.int64).tobytes()]})

    # Packed by the tasks, 16 bytes each: at most ``MOST`` of them come to the driver.
    kept = found.filter(F.col("n") >= F.lit(1 << least if least < 63 else 2**63 - 1)).mapInPandas(packed, "hashes binary, counts binary").collect()
    join = lambda name: b"".join(bytes(row[name]) for row in kept)
    return np.frombuffer(join("hashes"), np.uint64), np.frombuffer(join("counts"), np.int64)


def _described(docs: DataFrame, order, shingle: int, percent: int) -> DataFrame:
    """``doc, n, s1, s2, g1, g2, prefix``: size and digest of a set; digest and shingles of its prefix."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, own_order = Sets(shingle), order.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"], batch["text"]):
                own = sets.of(text)
                prefix = own_order.prefix(own, percent).tobytes()
                out.append((doc, len(own), *_digest(own.tobytes()), *_digest(prefix, len(own).to_bytes(8, "big")), prefix))
            yield pd.DataFrame(out, columns=["doc", "n", "s1", "s2", "g1", "g2", "prefix"])

    return docs.mapInPandas(describe, "doc bigint, n bigint, s1 bigint, s2 bigint, g1 bigint, g2 bigint, prefix binary")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``doc, shingles`` of some documents."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(shingle)
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "shingles": [sets.of(t).tobytes() for t in batch["text"]]})

    return docs.join(nodes.select("doc").distinct(), "doc", "left_semi").mapInPandas(make, "doc bigint, shingles binary")


# Pairs


def _may(percent: int) -> Column:
    """Whether sizes and places of a common shingle allow a link; sides ``a`` and ``b`` with ``n`` and ``pos``."""
    na, nb, pa, pb = (F.col(c) for c in ("na", "nb", "pa", "pb"))
    small = F.when(na <= nb, pa < _index_size(na, percent)).otherwise(pb < _index_size(nb, percent))
    rest = 1 + F.least(na - pa - 1, nb - pb - 1)
    sizes = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * rest >= percent * (na + nb))
    return sizes & small


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    """Group rows as one side of a pair."""
    return rows.select(*more, F.col("gid").alias(side), F.col("n").alias(f"n{side}"), F.col("pos").alias(f"p{side}"))


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _filtered(pairs: DataFrame, groups: DataFrame, order, percent: int) -> DataFrame:
    """Those of the group pairs ``a, b`` whose prefixes allow a link."""

    @F.pandas_udf("boolean")
    def may(pa: pd.Series, pb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        own, read = order.value, lambda x: np.frombuffer(x, np.uint64)
        return pd.Series([own.may_link(read(x), read(y), m, n, percent) for x, y, m, n in zip(pa, pb, na, nb)], dtype=bool)

    left = groups.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("xa"))
    right = groups.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("xb"))
    return pairs.join(left, "a").join(right, "b").filter(may("xa", "xb", "na", "nb")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` of documents whose whole sets link."""

    @F.pandas_udf("boolean")
    def link(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append((100 + percent) * shared >= percent * (len(a) + len(b)))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(link("x", "y")).select("a", "b")


def _star(tokens: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: each group of a shingle's list with the list's centre, which another hash chooses every round."""
    # The same hash for all lists, so that those of one family mostly share a centre.
    rank = F.xxhash64(F.lit(turn), "gid")
    centre = tokens.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "gid", "n", "pos")).alias("c"))
    centre = centre.select("token", F.col("c.gid").alias("b"), F.col("c.n").alias("nb"), F.col("c.pos").alias("pb"))
    return _ordered_pairs(_side(tokens, "a", "token").join(centre, "token").filter((F.col("a") != F.col("b")) & _may(percent)))


def _entries(tokens: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """``token, root, root2, a, b, single, groups``: pairs of components that meet in a list.

    ``own`` has ``gid, root``: the components of a group's members. A list is first reduced to its components. Where both
    have one group in the list (``single``), that pair ``a, b`` has been judged. ``groups`` are those of ``root`` there.
    """
    held = tokens.join(own, "gid").groupBy("token", "root").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("groups"), F.min(F.struct("gid", "n", "pos")).alias("g")
    )
    mixed = held.groupBy("token").agg(F.min("root").alias("first"), F.max("root").alias("last")).filter("first < last").select("token")
    held = written(held.join(mixed, "token", "left_semi"), "join-held")
    one = held.select("token", "root", "low", "high", "groups", *[F.col(f"g.{f}").alias(t) for f, t in (("gid", "a"), ("n", "na"), ("pos", "pa"))])
    two = held.select(
        "token", F.col("root").alias("root2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("groups").alias("groups2"),
        *[F.col(f"g.{f}").alias(t) for f, t in (("gid", "b"), ("n", "nb"), ("pos", "pb"))],
    )
    close = (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))
    single = (F.col("groups") == 1) & (F.col("groups2") == 1)
    met = one.join(two, "token").filter((F.col("root") < F.col("root2")) & close & (~single | _may(percent)))
    return written(met.select("token", "root", "root2", "a", "b", single.alias("single"), "groups"), "join-roots")


def _centred(tokens: DataFrame, own: DataFrame, met: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: groups of the lists in which large components meet, with some ``CENTRES`` of other components, twice as many every round."""
    lists = met.filter("NOT single").select("token").distinct()
    rows = tokens.join(lists, "token", "left_semi").join(own, "gid")
    size = rows.groupBy("token").agg(F.count("*").alias("groups"))
    # The same hash for all lists, so that those of one family mostly share their centres.
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(turn), F.lit("centres"), "gid"), 33) / F.lit(2.0**31)
    centres = rows.join(size, "token").filter(rank * F.col("groups") < CENTRES << turn)
    right = _side(centres.withColumnRenamed("root", "root2"), "b", "token", "root2")
    pairs = _side(rows, "a", "token", "root").join(right, "token").filter((F.col("root") != F.col("root2")) & (F.col("a") != F.col("b")) & _may(percent))
    return _ordered_pairs(pairs)


def _across(tokens: DataFrame, own: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of groups of one list with members in different components, one group with itself included."""
    rows = tokens.join(own, "gid")
    roots = met.filter("NOT single").select("token", "root", "root2")
    left = _side(rows, "a", "token", "root")
    right = _side(rows.withColumnRenamed("root", "root2"), "b", "token", "root2")
    wide = roots.join(left, ["token", "root"]).join(right, ["token", "root2"]).filter(_may(percent))
    met = met.filter("single").select("a", "b").unionByName(wide.select("a", "b")).filter("a <> b")
    inside = own.groupBy("gid").agg(F.count("*").alias("roots")).filter("roots > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    return _ordered_pairs(met).unionByName(inside)


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(documents, links)``.

    ``documents``: per row ``doc_id, n_shingles, class_id, component_id``; documents of a class have equal sets.
    ``links``: ``a, b`` between class ids, verified, enough to connect every component.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    order = spark.sparkContext.broadcast(Order(*_frequent(rows, shingle)))
    described = written(_described(rows, order, shingle, percent), "join-sets")
    kind = ["n", "s1", "s2"]
    nodes = described.filter("n > 0").groupBy(*kind, "g1", "g2").agg(F.min("doc").alias("doc"))
    nodes = written(nodes, "join-nodes")
    firsts = nodes.groupBy("n", "g1", "g2").agg(F.min("doc").alias("gid"), F.count("*").alias("members"))
    member = nodes.join(firsts, ["n", "g1", "g2"]).select("doc", "gid", "n", "members")
    member = written(member, "join-members")
    # One of the rows of the group's first document with that prefix is as good as another.
    of_first = described.select(F.col("doc").alias("gid"), "n", "g1", "g2", "prefix")
    groups = firsts.join(of_first, ["gid", "n", "g1", "g2"]).dropDuplicates(["gid", "n", "g1", "g2"]).select("gid", "n", "prefix")
    groups = written(groups, "join-groups")

    @F.pandas_udf("array<bigint>")
    def shingles(prefix: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, np.int64) for p in prefix], dtype=object)

    tokens = groups.select("gid", "n", F.posexplode(shingles("prefix")).alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).filter("low < high").select("token")
    tokens = written(tokens.join(shared, "token", "left_semi"), "join-tokens")

    inside = member.filter("members > 1 and doc <> gid").select(F.col("gid").alias("a"), F.col("doc").alias("b"))
    pairs = written(inside, "join-pairs")
    done = pairs.limit(0)
    links = [done]
    for turn in range(rounds):
        candidates = written(_filtered(_star(tokens, turn, percent), groups, order, percent), "join-pairs")
        pairs = pairs.unionByName(candidates) if turn == 0 else candidates
        found = written(_verified(pairs.join(done, ["a", "b"], "left_anti"), rows, shingle, percent), "join-links")
        links.append(found)
        done = done.unionByName(pairs)
    rows_of_lists = tokens.count()
    for turn in range(CENTRE_ROUNDS + 1):
        roots = components(_union(links))
        own = member.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        own = written(own.select("doc", "gid", "root"), "join-roots")
        held = own.select("gid", "root").distinct()
        met = _entries(tokens, held, percent)
        # A family that is not one component yet would be paired with itself below.
        wide = met.filter("NOT single").agg(F.sum("groups")).first()[0] or 0
        if turn == CENTRE_ROUNDS or 2 * wide <= rows_of_lists:
            break
        # Where no two components allow a link now, none will: they only merge.
        tokens = written(tokens.join(met.select("token").distinct(), "token", "left_semi"), "join-tokens")
        pairs = written(_filtered(_centred(tokens, held, met, turn, percent), groups, order, percent), "join-pairs")
        links.append(written(_verified(pairs.join(done, ["a", "b"], "left_anti"), rows, shingle, percent), "join-links"))
        done = done.unionByName(pairs)
    across = written(_across(tokens, held, met, percent), "join-pairs")
    apart = written(_filtered(across.filter("a <> b"), groups, order, percent).unionByName(across.filter("a = b")), "join-pairs")
    left = own.select(F.col("gid").alias("a"), F.col("doc").alias("x"), F.col("root").alias("root_x"))
    right = own.select(F.col("gid").alias("b"), F.col("doc").alias("y"), F.col("root").alias("root_y"))
    expanded = apart.join(left, "a").join(right, "b").filter("root_x <> root_y and (a <> b or x < y)")
    expanded = _ordered_pairs(expanded.select(F.col("x").alias("a"), F.col("y").alias("b"))).join(done, ["a", "b"], "left_anti")
    links.append(written(_verified(written(expanded, "join-pairs"), rows, shingle, percent), "join-links"))
    links = _union(links).distinct()

    classes = nodes.select(*kind, F.col("doc").alias("class_id"))
    named = described.select("doc", *kind).join(classes, kind, "left")
    named = named.withColumn("class_id", F.coalesce("class_id", "doc"))
    # Texts of one document may be in several classes.
    versions = named.groupBy("doc").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a < b")
    same = named.join(versions.select("doc", "a"), "doc").filter("a <> class_id").select("a", F.col("class_id").alias("b"))
    roots = components(links.unionByName(same)).select(F.col("node").alias("class_id"), "root")
    out = named.join(roots, "class_id", "left")
    plain = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    documents = out.withColumn("root", F.coalesce("root", "class_id")).select(
        plain("doc").alias("doc_id"), F.col("n").alias("n_shingles"), plain("class_id").alias("class_id"), plain("root").alias("component_id")
    )
    return documents, links


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    return _linked(pairs, written(_sets(rows, ends, shingle), "join-texts"), percent).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
