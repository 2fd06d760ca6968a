"""Fuzzy line dedup by MinHash (native).

Lines (cut at ``\\n``) are lower-cased and their white space is made single, none at the
ends; equal ones are one node. What stays is put out as it was. A node's shingles are all its windows of ``shingle`` characters, the whole line if
it is shorter. Nodes link where the Jaccard similarity of their shingle sets is at
least ``similarity``. Of each component one line stays, the first by (doc_id, line
number); the others go. Lines without a word always stay.

Signature: shingle hashes lie on a circle; the i-th of ``bands * rows`` evenly spaced
points takes the next hash after it, which two sets share with the probability of their
similarity. One sort of a line's hashes yields the whole signature. ``rows`` values make
a band key. With 10 bands of 4, lines at similarity 0.8 share a key with probability
0.995, at 0.9 with more than 0.9999 (many shingles; short lines somewhat less).

Inside a key every member is compared with the key's centre, by exact Jaccard of whole
sets. What then holds several components is compared pair by pair, if the key has few
members. In larger ones, members that do not link to a centre go on, with a new centre, for
``star_rounds``. Keys choose their centres by different hashes. Large keys that then still hold
several components go through an exact prefix join: their members' shingles are counted, each
member is filed under the rarest fifth or so of its own, compared with the centres of these lists first, and then
members of different components that meet there, at places that allow the similarity asked for,
are compared. So two members of a key that
are similar are always in one component, and a passage that many different lines hold pairs
none of them. Before any two lines are compared, the sizes of their sets and the first hashes
of their arcs must allow the similarity as well.

Defined results: null and empty texts have no lines with a word and stay as they are;
rows with equal doc_id and text count as one document, and the same lines go from each;
a null doc_id sorts first; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.llm.common import SPACES, bind, text_of
from sitemarks.llm.components import components
from sitemarks.session import written

SHINGLE = 9
SIMILARITY = 0.8
BANDS = 10
ROWS = 4
STAR_ROUNDS = 3
#: Windows that are cut from one piece of a line that is not ASCII.
PIECE = 8
#: Members of a key that are compared as one block with the others.
BLOCK = 2048
#: Members up to which a key that holds several components has these compared pair by pair; so a member has fewer pairs than that per key.
PAIRED = 32
#: Arcs of the circle of hashes, 2 ** ARC_BITS; no fewer than ``bands * rows``.
ARC_BITS = 6

_NULL_ID = -(2**63)


def _replaced(text: Column, old: str, new: str) -> Column:
    """Looking for a text is several times cheaper than replacing it, and most texts hold none of these."""
    return bind(text, lambda x: F.when(F.contains(x, F.lit(old)), F.replace(x, F.lit(old), F.lit(new))).otherwise(x))


def normal(text: Column) -> Column:
    """A text whose lines are lower-cased, their white space single blanks, none at a line's ends."""
    for c in SPACES.replace("\n", "").strip(" "):
        text = _replaced(text, c, " ")
    # Plain searches of whole texts; the regex meets only texts with a run of blanks.
    one = bind(text, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    return F.lower(F.trim(_replaced(_replaced(one, " \n", "\n"), "\n ", "\n")))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, copy, line_no, line``: every line with a word; ``doc, copy`` names the document."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc")
    rows = docs.select(doc, F.xxhash64("text").alias("copy"), normal(text_of()).alias("text"))
    # Not posexplode: Spark would filter on the size first, which makes every text normal a second time.
    split = rows.select("doc", "copy", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.filter("line <> ''")


def _node() -> Column:
    return F.xxhash64("line")


def _window_hashes(line: str, shingle: int) -> str:
    """Hashes of all windows of a line as they come, possibly with repeats."""
    # In text that is not ASCII, substring counts from the start, so the line is cut into pieces of PIECE windows first, the last of
    # them from its end. Fewer windows than that are counted out.
    full = PIECE + shingle - 1
    pieces = f"concat(regexp_extract_all({line}, '(?s)(?=(.{{{full}}})).{{{PIECE}}}', 1), array(right({line}, {full})))"
    each = ", ".join(f"xxhash64(substring(p, {i}, {shingle}))" for i in range(1, PIECE + 1))
    short = f"transform(sequence(1, length({line}) - {shingle - 1}), i -> xxhash64(substring({line}, i, {shingle})))"
    every = f"if(length({line}) < {full}, {short}, flatten(transform({pieces}, p -> array({each}))))"
    # In ASCII text characters are bytes, of which a window is cut without counting; its hash is the same.
    plain = f"sequence(1, octet_length(b) - {shingle - 1}), i -> xxhash64(substring(b, i, {shingle}))"
    plain = f"transform(array(cast({line} as binary)), b -> transform({plain}))[0]"
    every = f"if(octet_length({line}) = length({line}), {plain}, {every})"
    return f"if(length({line}) < {shingle}, array(xxhash64({line})), {every})"


def shingle_hashes(line: str, shingle: int = SHINGLE) -> Column:
    """Sorted hashes of all windows of a line, possibly with repeats."""
    return F.expr(f"sort_array({_window_hashes(line, shingle)})")


def _points(bands: int, rows: int) -> list[list[int]]:
    """Per band the beginnings of its arcs, as signed numbers."""
    arcs = 1 << ARC_BITS
    if bands * rows > arcs:
        raise ValueError(f"{bands} bands of {rows} rows need more than {arcs} arcs")
    # A band's points lie far apart: in a short line, neighbouring points have the same successor.
    step = arcs // rows
    return [[(b * step // bands + r * step - arcs // 2) << (64 - ARC_BITS) for r in range(rows)] for b in range(bands)]


def _is_hash(x: str) -> str:
    """Whether this is no point: a point has zeros below its arc's number."""
    return f"shiftleft({x}, {ARC_BITS}) <> 0"


def _successors(lines: DataFrame, shingle: int, bands: int, rows: int, *own: str) -> DataFrame:
    """``node, next`` and ``own`` columns: for each point, in their order, the hash that follows it, past the last one the first of all.

    The points are sorted among the hashes and then searched for, which is generated code; a function of every window
    would be called for each of them.
    """
    points = sorted(sum(_points(bands, rows), []))
    # The least long has no literal.
    literals = [f"({x + 1}L - 1L)" for x in points]
    every = F.expr(f"sort_array(concat({_window_hashes('line', shingle)}, array({', '.join(literals)})))")
    after = [f"get(s, cast(array_position(s, {x}) as int))" for x in literals]
    # Beside this filter Spark makes a method of each search, not one of all, which would be too long to be compiled.
    first = f"get(filter(slice(s, 1, {len(points) + 1}), x -> {_is_hash('x')}), 0)"
    found = lines.select(_node().alias("node"), *own, every.alias("s"))
    found = found.select("node", *own, F.expr(f"array({', '.join([*after, first])})").alias("next"))
    # Where another point follows, what follows that. Few long lines have such points.
    later = f"filter(slice(next, i + 2, {len(points) + 1}), y -> {_is_hash('y')})"
    full = f"transform(next, (x, i) -> if(coalesce({_is_hash('x')}, false), x, get({later}, 0)))"
    whole = " AND ".join(_is_hash(f"next[{i}]") for i in range(len(points)))
    return found.select("node", *own, F.expr(f"if(coalesce({whole}, false), next, {full})").alias("next"))


def band_keys(successors: str, bands: int = BANDS, rows: int = ROWS) -> Column:
    """The band keys of the hashes that follow the points."""
    own = _points(bands, rows)
    place = {x: i for i, x in enumerate(sorted(sum(own, [])))}
    values = lambda b: ", ".join(f"{successors}[{place[x]}]" for x in own[b])
    return F.expr(f"array({', '.join(f'xxhash64({b}, {values(b)})' for b in range(bands))})")


def _candidates(banded: DataFrame) -> DataFrame:
    """``key, node, centre`` for the members of keys with more than one node, centres left out."""
    # The centre is the member with the smallest hash under its key, found with map-side combine.
    rank = F.xxhash64("key", "node")
    least = banded.groupBy("key").agg(
        F.min(F.struct(rank.alias("rank"), F.col("node"))).alias("least"),
        F.min("node").alias("low"), F.max("node").alias("high"),
    ).filter("low < high").select("key", F.col("least.node").alias("centre"))
    return banded.join(least, "key").filter("node <> centre").select("key", "node", "centre")


def _marks(shingle: int, similarity: float) -> list[Column]:
    """Two steps to ``_m``: ``size`` of a line's set, and ``firsts``, the upper halves of the first hashes of its arcs.

    Sets so large that all arcs may differ in two similar ones have no ``firsts``, which could not tell them apart.
    """
    arc = lambda x: f"shiftright({x}, {64 - ARC_BITS})"
    firsts = f"transform(filter(h, (x, i) -> coalesce({arc('(x ^ get(h, i - 1))')} <> 0, true)), x -> cast(shiftright(x, 32) as int))"
    firsts = f"if(size(h) * {1 - similarity + 1e-9!r}D < {1 << ARC_BITS}, {firsts}, cast(array() as array<int>))"
    own = F.array(F.array_distinct(shingle_hashes("line", shingle))).alias("_h")
    return [own, F.expr(f"transform(_h, h -> struct(size(h) as size, {firsts} as firsts))[0]").alias("_m")]


def _close(a: str, b: str, least: float) -> Column:
    """Whether two sizes allow this similarity; rounding has room."""
    return F.least(a, b) >= F.lit(least - 1e-9) * F.greatest(a, b)


def _possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the distinct ``a, b`` whose sizes and arcs allow this similarity; loses none.

    Where two lines have different first hashes in an arc, the smaller one is in one set only. So their sets differ by
    at least as many hashes as there are such arcs, which a similarity s allows up to (1 - s) / (1 + s) of both sizes.
    """
    left = texts.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("firsts").alias("fa"))
    right = texts.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("firsts").alias("fb"))
    apart = F.greatest(F.size("fa"), F.size("fb")) - F.size(F.array_intersect("fa", "fb"))
    allowed = F.lit((1 - least) / (1 + least) + 1e-9) * (F.col("na") + F.col("nb"))
    return pairs.join(left, "a").join(right, "b").filter(_close("na", "nb", least) & (apart <= allowed)).select("a", "b")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``a, b, jaccard``: those of the distinct ``a, b`` whose shingle sets have at least this similarity."""
    pairs = written(_possible(pairs, texts, least), "line-pairs")
    # Lines travel, not their sets, which are larger and do not compress.
    left = texts.select(F.col("node").alias("a"), F.col("line").alias("u"), F.col("size").alias("na"))
    right = texts.select(F.col("node").alias("b"), F.col("line").alias("v"), F.col("size").alias("nb"))
    # The sizes of the sets are known, so what they share is all to find out, without sorting and in generated code.
    shared = F.size(F.array_intersect(F.expr(_window_hashes("u", shingle)), F.expr(_window_hashes("v", shingle))))
    # The generator keeps the filter above it, which would compute the sets again.
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.explode(F.array(shared)).alias("n"))
    jaccard = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return both.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= F.lit(least))


def _unordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The equi-join of ``left`` with ``node`` and ``right``, block of ``left`` by block, so that no key is one task's."""
    blocks = left.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = left.join(blocks, on).withColumn("block", F.pmod(F.xxhash64("node", *on), F.col("blocks")).cast("int")).drop("blocks")
    every = right.join(blocks, on).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.join(every, [*on, "block"])


def _open(banded: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, root, members``: the keys that hold two components so far."""
    held = written(banded.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "line-held")
    mixed = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    return held.join(mixed.filter("low < high").select("key", "members"), "key")


def _inside(held: DataFrame, tried: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs within keys that are in two components so far, but for those that were compared."""
    sized = held.join(texts.select("node", "size"), "node").select("key", "node", "root", "size")
    other = [F.col(c).alias(to) for c, to in (("node", "other"), ("root", "root2"), ("size", "size2"))]
    met = sized.join(sized.select("key", *other), "key").filter((F.col("root") < F.col("root2")) & _close("size", "size2", similarity))
    return met.select(*_unordered("node", "other")).distinct().join(tried, ["a", "b"], "left_anti")


def _prefixes(rest: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``token, node, root, size, pos``: the rarest shingles of each set, as far as another set has them.

    Similar sets have a common shingle among the first ``size - ceil(similarity * size) + 1`` of each, in any order
    that is the same for all. Rare ones come first: a passage that many lines hold is in no prefix of theirs.
    """
    # Not explode: Spark would filter on the size first, which computes the hashes a second time.
    own = F.explode_outer(F.array_distinct(F.expr(_window_hashes("line", shingle))))
    every = written(texts.join(rest.select("node"), "node", "left_semi").select("node", own.alias("token")), "line-shingles")
    often = every.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    met = every.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("met"))
    # Shingles that no other set has come first and need no row; the size has room for rounding.
    first = F.col("size") - F.ceil(F.lit(similarity - 1e-9) * F.col("size")) + 1
    alone = F.col("size") - F.size("met")
    cut = met.join(texts.select("node", "size"), "node").join(rest, "node").withColumn("alone", alone)
    cut = cut.select("node", "root", "size", "alone", F.slice("met", F.lit(1), F.greatest(F.lit(0), first - F.col("alone")).cast("int")).alias("met"))
    return cut.select("node", "root", "size", "alone", F.posexplode("met").alias("i", "m")).select(
        F.col("m.token").alias("token"), "node", "root", "size", (F.col("alone") + F.col("i")).alias("pos")
    )


def _may(similarity: float) -> Column:
    """Whether sizes and places of a common shingle allow a link, if that shingle is the first in common; loses none."""
    size, size2, pos, pos2 = (F.col(c) for c in ("size", "size2", "pos", "pos2"))
    enough = F.lit(1 + similarity + 1e-9) * F.least(size - pos, size2 - pos2) >= F.lit(similarity) * (size + size2)
    # Of the smaller set, what both share is the larger part.
    rest = lambda n: n - F.ceil(F.lit(2 * similarity / (1 + similarity) - 1e-9) * n)
    early = F.when(size <= size2, pos <= rest(size)).otherwise(pos2 <= rest(size2))
    return _close("size", "size2", similarity) & enough & early


def _other(prefixes: DataFrame) -> DataFrame:
    renamed = [F.col(c).alias(to) for c, to in (("node", "other"), ("root", "root2"), ("size", "size2"), ("pos", "pos2"))]
    return prefixes.select("token", *renamed)


def _list_stars(prefixes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: members of a shingle's list with the list's centre."""
    # The same hash for all lists, so that those of one family mostly share a centre.
    rank = F.xxhash64("node")
    own = prefixes.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "node", "root", "size", "pos")).alias("c"))
    centres = _other(own.select("token", "c.*"))
    met = prefixes.join(centres, "token").filter((F.col("root") != F.col("root2")) & _may(similarity))
    return met.select(*_unordered("node", "other")).distinct()


def _mixed(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that hold several components by now, with these."""
    known = prefixes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known.select(*prefixes.columns), "line-lists")
    mixed = known.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    return written(known.join(mixed, "token", "left_semi"), "line-lists")


def _across(prefixes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs that may link and are in two components so far."""
    met = _met(prefixes, _other(prefixes), ["token"]).filter((F.col("root") < F.col("root2")) & _may(similarity))
    return met.select(*_unordered("node", "other")).distinct()


def line_links(docs: DataFrame, **parameters) -> DataFrame:
    """``a, b``: hashes of distinct lines, with the components that verified links make, which connect what shares a key and is similar."""
    return _signed_and_links(docs, **parameters)[1]


def _signed_and_links(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    star_rounds: int = STAR_ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """``node, doc, copy, line_no`` of every line, written with its keys so that no text is read again for its place, and the links."""
    place = ["doc", "copy", "line_no"]
    signed = _successors(_lines(docs), shingle, bands, rows, *place)
    signed = written(signed.select("node", *place, band_keys("next", bands, rows).alias("keys")), "line-keys")
    return signed.drop("keys"), _links(docs, signed, shingle, similarity, star_rounds)


def _links(docs: DataFrame, signed: DataFrame, shingle: int, similarity: float, star_rounds: int) -> DataFrame:
    signed = signed.select("node", F.explode("keys").alias("key"))
    # One row per key and node; then only the keys that two nodes share, written once.
    shared = F.count("*").over(Window.partitionBy("key")) > 1
    banded = signed.repartition("key").distinct().withColumn("more", shared).filter("more").drop("more")
    banded = written(banded, "line-bands")
    nodes = banded.select("node").distinct()
    lines = _lines(docs).select(_node().alias("node"), "line").join(nodes, "node", "left_semi")
    one = lines.groupBy("node").agg(F.first("line").alias("line"))
    hashed, marks = _marks(shingle, similarity)
    texts = written(one.select("node", "line", hashed).select("node", "line", marks).select("node", "line", "_m.*"), "line-texts")

    def near(pairs: DataFrame) -> DataFrame:
        return written(_compared(pairs, texts, shingle, similarity), "line-near").select("a", "b")

    none = banded.selectExpr("node AS a", "node AS b").limit(0)
    found, waiting, held = [none], banded, banded
    for turn in range(star_rounds):
        stars = written(_candidates(waiting), "line-stars")
        pairs = stars.select(*_unordered("node", "centre")).distinct()
        found.append(near(pairs))
        both = found[-1].unionByName(found[-1].select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = both.select(F.col("a").alias("node"), F.col("b").alias("centre"))
        waiting = stars.join(linked, ["node", "centre"], "left_anti").select("key", "node")
        if turn == 0:
            # Most keys have few members, and all that is left of these are few pairs.
            roots = components(found[-1])
            held = written(_open(banded, roots), "line-open")
            found = [_stars(roots), near(_inside(held.filter(F.col("members") <= PAIRED), pairs, texts, similarity))]
            held = held.filter(F.col("members") > PAIRED)
            waiting = waiting.join(held.select("key").distinct(), "key", "left_semi")
            held = held.select("key", "node")
        waiting = written(waiting, "line-bands")
        if waiting.isEmpty():
            break
    if held.isEmpty():
        return _union(found).distinct()
    roots = components(_union(found))
    rest = written(_open(held, roots).select("node", "root").distinct(), "line-rest")
    if rest.isEmpty():
        return _stars(roots)
    lists = written(_prefixes(rest, texts, shingle, similarity), "line-lists")
    roots = components(_stars(roots).unionByName(near(_list_stars(lists, similarity))))
    lists = _mixed(lists, roots)
    if lists.isEmpty():
        return _stars(roots)
    across = written(_across(lists, similarity), "line-pairs")
    return _stars(roots).unionByName(_compared(across, texts, shingle, similarity).select("a", "b"))


def _stars(roots: DataFrame) -> DataFrame:
    """Components as links, to which later ones are added."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kept_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``doc, copy, keep``: per document the numbers of its lines that are the first of their component.

    Documents none of whose lines is first have no row. Only first lines are grouped by
    document, so neither a frequent line nor a large component is ever one group's rows.
    """
    every, links = _signed_and_links(docs, **parameters)
    roots = components(links)
    place = F.struct("doc", "copy", "line_no")
    first = every.select("node", place.alias("place")).groupBy("node").agg(F.min("place").alias("place"))
    named = first.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "place")
    kept = named.groupBy("root").agg(F.min("place").alias("place")).select("place.*")
    return kept.groupBy("doc", "copy").agg(F.sort_array(F.collect_list("line_no")).alias("keep"))


def line_decisions(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, n_lines, n_with_words, removed``: per row the numbers of the lines that go."""
    kept = kept_lines(docs, **parameters)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc")
    numbers = F.expr(
        r"filter(transform(split(coalesce(text, ''), '\n', -1), (l, i) -> if(l rlike '[^\\x20\\x09-\\x0D]', i, -1)), i -> i >= 0)"
    )
    split = F.size(F.split(text_of(), "\n", -1)).cast("long")
    rows = docs.select(
        "doc_id", doc, F.xxhash64("text").alias("copy"), F.when(F.col("text").isNull(), 0).otherwise(split).alias("n_lines"), numbers.alias("own")
    )
    return rows.join(kept, ["doc", "copy"], "left").select(
        "doc_id", "n_lines", F.size("own").cast("long").alias("n_with_words"),
        F.array_except("own", F.coalesce("keep", F.array().cast("array<int>"))).alias("removed"),
    )


def dedup_lines(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with their texts reduced to the lines that stay; every row stays, columns as they were."""
    kept = kept_lines(docs, **parameters)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_llm_doc"),
        F.xxhash64("text").alias("_llm_copy"),
        F.struct(*columns).alias("_llm_row"),
    )
    joined = rows.join(
        kept.select(F.col("doc").alias("_llm_doc"), F.col("copy").alias("_llm_copy"), "keep"), ["_llm_doc", "_llm_copy"], "left"
    )
    # Both sides are in line order, so membership is a hash set over the numbers, not a scan per line.
    body = F.expr(
        r"""transform(array(split(_llm_row.text, '\n', -1)), l -> array_join(transform(
              array_sort(concat(coalesce(keep, cast(array() as array<int>)),
                filter(transform(l, (x, i) -> if(x rlike '[^\\x20\\x09-\\x0D]', -1, i)), i -> i >= 0))),
              i -> l[i]), '\n'))[0]"""
    )
    text = F.when(F.col("_llm_row.text").isNotNull(), body)
    return joined.withColumn("_llm_row", F.col("_llm_row").withField("text", text)).select("_llm_row.*")
