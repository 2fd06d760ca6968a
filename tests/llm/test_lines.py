"""Lines against brute force over all windows of their characters."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from sitemarks.llm import components, lines


def _windows(line):
    return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def _jaccard(a, b):
    return len(_windows(a) & _windows(b)) / len(_windows(a) | _windows(b))


def _links(texts):
    return {frozenset(p) for p in combinations(texts, 2) if _jaccard(*p) >= lines.SIMILARITY}


def _removed(texts, link=None):
    """Numbers of the lines that are not the first of their component."""
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(sorted, _links(root) if link is None else link):
        root[find(a)] = find(b)
    seen = set()
    return {i for i, x in enumerate(texts) if find(x) in seen or seen.add(find(x))}


def _got(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in lines.line_decisions(docs).collect() if r.removed}


def _long_words():
    r = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x4F00)] + ["\U00020000", "\U0001f389"]
    texts = ["id: 1234567890123", "id: 1234567890999", "x" * 300, "x" * 9, "short", "\U0001f389" * 8, "a b\u0085" + "c" * 90]
    for make in (
        lambda: "https://www.example.com/" + "".join(r.choices("abcdefgh0123456789-/", k=120)),
        lambda: "".join(r.choices(han, k=200)),
        lambda: "".join(r.choices("abcdefghij", k=r.randint(9, 200))),
    ):
        for _ in range(12):
            texts.append(make())
        old = texts[-1] * 2
        texts += [old, old[:-3] + "zzz", old[:150] + "yy" + old[150:]]
    return texts


def test_hashes_are_of_all_windows(spark):
    texts = _long_words() + ["a" * 8 + "b" * n for n in (0, 1, 2, 55, 56, 57, 63, 64, 65, 120, 128, 129)]
    frame = spark.createDataFrame([(i, x, sorted(_windows(x))) for i, x in enumerate(texts)], "i int, line string, w array<string>")
    own = F.array_distinct(lines.shingle_hashes("line"))
    wrong = frame.filter(own != F.expr("sort_array(transform(w, x -> xxhash64(x)))"))
    assert wrong.count() == 0


def test_long_words_links_and_han(spark):
    texts = _long_words()
    expected = _removed(texts)
    assert len(expected) >= 3
    assert _got(spark, texts) == expected


def test_chained_family_in_one_key(spark, monkeypatch):
    """All lines share their keys, and each is similar to few others: no centre is near to most."""
    r = random.Random(11)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200 + 6 * 150))
    chain = [text[6 * i : 6 * i + 200] for i in range(150)]
    family = [x for x in chain if r.random() < 0.9]
    spokes = ["".join(r.choices("0123456789", k=150)) for _ in range(5)]
    texts = [*family, *[x + y for x in spokes for y in ("", "abcdefg", "hijklmnopq", "uvw" * 6)]]
    r.shuffle(texts)
    monkeypatch.setattr(lines, "band_keys", lambda hashes, bands, rows: F.expr("array(1L)"))
    monkeypatch.setattr(lines, "BLOCK", 16)
    assert _got(spark, texts) == _removed(texts)


def test_case_and_white_space_do_not_count(spark):
    line = "The quick brown fox jumps over the lazy dog, and so on"
    texts = [line, line.upper(), line.replace(" ", "  "), " \t" + line.replace(" ", "\t") + "\r", line.replace(" ", " \x0b"), line.replace(" ", "")]
    assert _got(spark, texts) == {1, 2, 3, 4}
    docs = spark.createDataFrame([(0, line.upper() + " \n" + line + "\n\n" + texts[5])], "doc_id bigint, text string")
    assert lines.dedup_lines(docs).first().text == line.upper() + " \n\n" + texts[5]


def test_texts_are_made_normal_once(spark):
    """Per pass and whole text; as the rule says for one line, whatever stands at a line's ends."""
    blanks, r = " \t\x0b\f\r", random.Random(3)
    texts = ["".join(r.choices(["\n", *blanks, "A", "\u0130x", "\u00c9", "O\u03a3", "\u03a3", "\u00a0", "\u0085", "  "], k=r.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (7, "")], "doc_id bigint, text string")
    single = F.regexp_replace(F.btrim("line", F.lit("\n" + blanks)), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    each = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    expected = each.withColumn("line", F.lower(single)).filter("line <> ''").collect()
    got = lines._lines(docs)
    assert len(expected) > 500 and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_ascii_windows_are_cut_from_bytes(spark):
    """Lines of one byte a character need no counting of characters; others are cut as before."""
    plan = spark.range(1).select(F.lit("x" * 40).alias("line")).select(lines.shingle_hashes("line").alias("h"))
    assert "as binary" in plan._jdf.queryExecution().logical().toString().lower()


def test_common_passage_in_one_key(spark, monkeypatch):
    """Lines that share a key and a long passage, but little else, are not compared pair by pair; near copies among them are found."""
    r = random.Random(17)
    own = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = own(120)
    texts = [own(45) + passage + own(45) for _ in range(140)]
    texts += [x[:-6] + own(6) for x in texts[:10]]
    compared, pairs = lines._compared, []
    monkeypatch.setattr(lines, "_compared", lambda p, *rest: pairs.append(p.distinct().count()) or compared(p, *rest))
    monkeypatch.setattr(lines, "band_keys", lambda hashes, bands, rows: F.expr("array(1L)"))
    assert _got(spark, texts) == _removed(texts)
    assert sum(pairs) < 8 * len(texts) < len(texts) ** 2 / 10


def test_searched_successors_make_the_keys(spark):
    """The keys of arcs' first hashes, by plain Python."""
    texts = [*_long_words()[:30], "tiny", "x" * 9, "ten chars!"]
    frame = spark.createDataFrame([(x,) for x in texts], "line string").withColumn("h", lines.shingle_hashes("line"))
    got = {r.node: r.k for r in lines._successors(frame, lines.SHINGLE, 10, 4).select("node", lines.band_keys("next").alias("k")).collect()}
    rows = []
    for r in frame.select("line", F.xxhash64("line").alias("node"), "h").collect():
        hashes, step = sorted(r.h), 16
        points = [[(b * step // 10 + i * step - 32) << 58 for i in range(4)] for b in range(10)]
        rows.append((r.node, [[b, *[next((h for h in hashes if h >= p), hashes[0]) for p in own]] for b, own in enumerate(points)]))
    keyed = spark.createDataFrame(rows, "node bigint, v array<array<bigint>>")
    key = F.expr("transform(v, x -> xxhash64(cast(x[0] as int), x[1], x[2], x[3], x[4]))")
    assert {r.node: r.k for r in keyed.select("node", key.alias("k")).collect()} == got


def test_few_members_are_compared_directly(spark, monkeypatch):
    """What is left of a key with few members after its centre are a few pairs, for which no shingle is filed."""
    r = random.Random(23)
    own = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    base = [own(400), own(90), own(60)]
    texts = [x[: len(x) - k] + own(k) for x in base for k in (0, 5, 9, 14, 22, 40)]
    assert len(texts) <= lines.PAIRED
    monkeypatch.setattr(lines, "band_keys", lambda hashes, bands, rows: F.expr("array(1L)"))
    filed, prefixes = [], lines._prefixes
    monkeypatch.setattr(lines, "_prefixes", lambda *a: filed.append(a) or prefixes(*a))
    assert _got(spark, texts) == _removed(texts) and not filed
    monkeypatch.setattr(lines, "PAIRED", 4)
    assert _got(spark, texts) == _removed(texts) and filed


def test_places_allow_every_similar_pair(spark):
    """Sets that share what follows a place in both, exactly as many as the similarity asks for included."""
    rows = []
    for size in range(1, 41):
        for size2 in range(1, 41):
            shared = -(-4 * (size + size2) // 9)  # the least for 0.8
            if shared <= min(size, size2):
                rows += [(size, size2, pos, pos2) for pos in range(size - shared + 1) for pos2 in range(size2 - shared + 1)]
    frame = spark.createDataFrame(rows, "size int, size2 int, pos int, pos2 int")
    assert frame.filter(~lines._may(0.8)).count() == 0
    assert frame.filter(lines._may(0.8).isNull()).count() == 0


def test_windows_of_other_text_are_cut_from_pieces(spark):
    """Of lines that are not ASCII, whatever their length is; pieces are cut, not counted through per window."""
    r = random.Random(29)
    texts = ["".join(r.choices("abä一\U0001f389", k=n)) + "ä" for n in range(70)]
    frame = spark.createDataFrame([(x, sorted(_windows(x))) for x in texts], "line string, w array<string>")
    own = F.array_distinct(lines.shingle_hashes("line"))
    assert frame.filter(own != F.expr("sort_array(transform(w, x -> xxhash64(x)))")).count() == 0
    assert lines._window_hashes("line", 9).count("xxhash64(substring(p, ") == lines.PIECE


def test_large_sets_have_no_firsts(spark):
    """All arcs may differ between large sets that are similar, so first hashes would not tell them apart."""
    r = random.Random(31)
    frame = spark.createDataFrame([("".join(r.choices("abcdefgh", k=n)),) for n in (20, 200, 320, 340, 900)], "line string")
    hashed, marks = lines._marks(lines.SHINGLE, 0.8)
    got = frame.select("line", hashed).select("line", marks).select(F.length("line").alias("n"), F.size("_m.firsts").alias("k")).collect()
    assert {r.n: r.k > 0 for r in got} == {20: True, 200: True, 320: True, 340: False, 900: False}


def test_band_keys_are_generated_code(spark):
    """No function of lambda variables makes the keys of a line whose points are all followed by hashes."""
    frame = spark.range(1).select(F.expr("array_repeat(id, 41)").alias("next"))
    plan = frame.select(lines.band_keys("next").alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_places_are_read_with_the_keys(spark, monkeypatch):
    """Texts are cut into lines to sign them and to compare them, not to place them once more."""
    made, own = [], lines._lines
    monkeypatch.setattr(lines, "_lines", lambda docs: made.append(1) or own(docs))
    assert _got(spark, ["one line and the same again", "One line  and the same again", "another"]) == {1}
    assert len(made) == 2


def test_stars_need_no_round(spark, monkeypatch):
    """Components that are stars already, as those that are carried on, cost no further contraction."""
    rounds, own = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda links: rounds.append(1) or own(links))
    stars = [(10 * i, 10 * i + k) for i in range(5) for k in range(1, 6)] + [(99, 99)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {**{b: a for a, b in stars}, **{10 * i: 10 * i for i in range(5)}} and not rounds
    path = [(i, i + 1) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(41), 0) and rounds
