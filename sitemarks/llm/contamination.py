"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of characters beyond ASCII, lower-cased
(A-Z). A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. The automaton of all items reads a document word by word and
keeps the longest suffix that occurs in an item; where that suffix is as long as a
window, or ends in a whole short item, the window's words are hit.

The automaton is the only thing that is broadcast. Items are read in blocks of at most
``block_words`` words (an item is never cut, so a block is one item larger at most); each
block has an automaton of its own and the hits of all blocks are united, so a large
benchmark takes more passes and not more memory. Runs of words that no item has are
skipped by a table look-up before the automaton is asked.

Defined results: null and empty texts have no words and are never contaminated; null or
wordless items hit nothing; items with equal words are all reported; repeated rows get
equal results; an empty benchmark or table gives no hits or no rows; ids of any type are
compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.session import scratch_path

WINDOW = 13
#: A document is contaminated if this share of its words, or more, is hit.
COVERAGE = (1, 20)
BLOCK_WORDS = 100_000

#: Bytes of a text to words: separators become blanks, A-Z become small letters.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Automaton:
    """All substrings of a block's items, as states of a generalised suffix automaton."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        for _, words in items:
            state, path = 0, []
            for w in words:
                state = self._extend(state, self.ids[w])
                path.append(state)
            ends.append(path)
        self._mark(items, ends)
        self.shortest = min((min(len(words), window) for _, words in items if words), default=window)

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, parent: int, word: int, target: int) -> int:
        copy = self._new(self.length[parent] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another item began alike
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            target = self.next[p][word]
            exact = self.length[target] == self.length[p] + 1
            self.link[state] = target if exact else self._clone(p, word, target)
        return state

    def _up(self, state: int, length: int) -> int:
        """The state of the suffix of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, items: list[tuple[str, list[bytes]]], ends: list[list[int]]) -> None:
        """Which items have a window that ends in a state; the lengths of windows by state."""
        self.items: dict[tuple[int, int], set[str]] = {}
        for (item, words), path in zip(items, ends):
            size = min(self.window, len(words))
            for state in path[size - 1 :] if words else ():
                self.items.setdefault((self._up(state, size), size), set()).add(item)
        self.sizes: dict[int, list[int]] = {}
        for state, size in self.items:
            self.sizes.setdefault(state, []).append(size)
        # A state's suffixes include those of its link: their windows end here, too.
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            inherited = [x for x in self.sizes.get(self.link[state], ()) if x not in self.sizes.get(state, ())]
            if inherited:
                self.sizes[state] = self.sizes.get(state, []) + inherited

    def hits(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit spans as flat ``start, end`` pairs (merged, end exclusive), and the items with windows."""
        code = self.ids.get
        codes = np.array([code(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).astype(np.int8), [0]))))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.shortest
        spans: list[int] = []
        found: set[str] = set()
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            self._read(codes[begin:end].tolist(), begin, spans, found)
        return spans, found

    def _read(self, codes: list[int], at: int, spans: list[int], found: set[str]) -> None:
        state, length = 0, 0
        for position, code in enumerate(codes, at + 1):
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(code, 0)
            length = length + 1 if state else 0
            if length < self.shortest:
                continue
            for size in self.sizes.get(state, ()):
                if size <= length:
                    found |= self.items[self._up(state, size), size]
                    start = position - size
                    while spans and spans[-2] >= start:  # what a longer window covers
                        del spans[-2:]
                    if spans and spans[-1] >= start:
                        spans[-1] = position
                    else:
                        spans += [start, position]


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of the items, a bounded number of words at a time; always at least one."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).filter(f"`{item_id}` IS NOT NULL")
    for item, body in rows.toLocalIterator():
        words = words_of(body)
        block.append((item, words))
        size += len(words)
        if size >= block_words:
            yield Automaton(block, window)
            block, size = [], 0
    if block or not size:
        yield Automaton(block, window)


_FOUND = "struct<n_words:bigint,spans:array<int>,items:array<string>>"


def _pass(automaton, text: Column) -> Column:
    @F.pandas_udf(_FOUND)
    def read(texts: pd.Series) -> pd.DataFrame:
        own, rows = automaton.value, []
        for t in texts:
            words = words_of(t)
            spans, found = own.hits(words)
            rows.append((len(words), spans, sorted(found)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return read(text)


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` plus ``_llm_found``: ``n_words``, ``n_hit``, merged word ``spans`` and sorted ``items``."""
    context = docs.sparkSession.sparkContext
    parts = []
    for automaton in blocks(benchmark, item_id, text, window, block_words):
        parts.append(_pass(context.broadcast(automaton), F.col("text")))
    if len(parts) == 1:
        merged = docs.withColumn("_llm_found", parts[0])
    else:
        merged = _united(docs, parts)
    ends = "transform(sequence(1, size(_llm_found.spans) div 2), k -> _llm_found.spans[2 * k - 1] - _llm_found.spans[2 * k - 2])"
    n_hit = F.expr(f"if(size(_llm_found.spans) = 0, 0L, aggregate({ends}, 0L, (a, x) -> a + x))")
    return merged.withColumn("_llm_found", F.col("_llm_found").withField("n_hit", n_hit))


def _united(docs: DataFrame, parts: list[Column]) -> DataFrame:
    """The hits of several blocks: each block's pass is written, so one automaton is in use at a time."""
    path = scratch_path(docs.sparkSession, "contamination")
    for k, part in enumerate(parts):
        last = docs.withColumn("_llm_found", F.lit(None).cast(_FOUND)) if not k else docs.sparkSession.read.parquet(f"{path}/{k - 1}")
        both = last.withColumn("_llm_new", part)
        both.withColumn("_llm_found", F.coalesce(_merge(F.col("_llm_found"), F.col("_llm_new")), "_llm_new")).drop(
            "_llm_new"
        ).write.parquet(f"{path}/{k}")
    return docs.sparkSession.read.parquet(f"{path}/{len(parts) - 1}")


def _merge(one: Column, two: Column) -> Column:
    @F.pandas_udf(_FOUND)
    def unite(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, x, y, s, t in zip(b["n_words"], a["spans"], b["spans"], a["items"], b["items"]):
            if x is None:
                x, s = [], []
            pairs = sorted([*zip(x[::2], x[1::2]), *zip(y[::2], y[1::2])])
            spans: list[int] = []
            for start, end in pairs:
                if spans and spans[-1] >= start:
                    spans[-1] = max(spans[-1], end)
                else:
                    spans += [int(start), int(end)]
            rows.append((n, [int(v) for v in spans], sorted({*s, *t})))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return unite(one, two)


def contaminated(n_hit: str = "_llm_found.n_hit", n_words: str = "_llm_found.n_words", coverage: tuple[int, int] = COVERAGE) -> Column:
    """Whether the hit share of the words reaches the limit."""
    return (F.col(n_hit) > 0) & (coverage[1] * F.col(n_hit) >= coverage[0] * F.col(n_words))


def cut(text: str, spans: list[int]) -> str:
    """A text without the words of the spans and what stands between them; the rest is untouched."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(_WORDS)
    begins, at = [], 0
    for w in plain.split():
        at = plain.index(w, at)
        begins.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        out.append(raw[last : begins[start][0]])
        last = begins[end - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: tuple[int, int] = COVERAGE, **parameters) -> DataFrame:
    """Documents beyond the coverage limit go; from the others, the spans that reach a window's length go."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_llm_row"), F.col("text"))
    # The generator keeps the filter above it, which would read every text a second time, in Python workers of its own.
    found = find_hits(rows, benchmark, **parameters).select("_llm_row", "text", F.explode(F.array("_llm_found")).alias("_llm_found"))
    found = found.filter(~F.coalesce(contaminated(coverage=coverage), F.lit(False)))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else cut(t, [int(x) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    text = without(F.col("text"), F.col("_llm_found.spans"))
    return found.withColumn("_llm_row", F.col("_llm_row").withField("text", text)).select("_llm_row.*")
