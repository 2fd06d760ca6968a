"""Wiring: one query per operator over the supplied tables, with its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.llm import (
    alignment, contamination, conversations, fixity, lines, ngramjoin, pieces, quality, repeats, secret_scan, shards, simhash, urlfilter,
)
from sitemarks.llm.common import table
from sitemarks.operators.ordered import join_null_safe
from sitemarks.session import written


def op1_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and those of a model trained from all documents."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = secret_scan.digest()
    count = lambda kind: F.expr(f"cast(size(filter(secrets, x -> x.kind = '{kind}')) as long)")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
    )


def op2_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the page archive that a replica with faults does not hold as they are."""
    rows = fixity.warc_rows(table(spark, sf_dir, "pages"))
    record, lost = fixity.faulty()
    # Records are hashed where they are read; what is ordered and joined are digests.
    digests = rows.select(
        "file", "page_id", F.length("record").cast("long").alias("size"),
        fixity.digest().alias("one"), fixity.digest(record).alias("two"), lost.alias("lost"),
    )
    placed = written(fixity.with_offsets(digests), "warc-digests")
    one = placed.select("file", "offset", F.col("one").alias("hash"))
    two = placed.filter("NOT lost").select("file", "offset", F.col("two").alias("hash"))
    return fixity.audit(one, two)[1]


def op3_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, and the numbers of those that go."""
    found = lines.line_decisions(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_with_words", F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, judged by the current policy, and by each other version."""
    led = quality.ledger(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        quality.passes(quality.CURRENT).alias("kept"),
        quality.BITS,
        quality.passes("base-1").alias("kept_base_1"),
    )


def op5_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_recompression_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op8_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_hits(docs, table(spark, sf_dir, "benchmark"))
    part = lambda name: F.col(f"_llm_found.{name}")
    return found.select(
        "doc_id", part("n_words").alias("n_words"), part("n_hit").alias("n_hit"),
        F.size(part("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(part("items"), ","), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, a digest of their ids, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pieces.load_model(pieces.default_model(spark))
    return pieces.round_trip(docs, model).select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.lossless")


def op10_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs; the model is trained from those that the rules judge."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urlfilter.train(urlfilter.labels_from_rules(pages))
    return urlfilter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rule, with their faults, least edits and a digest of the repaired rows."""
    rows = table(spark, sf_dir, "conversations")
    found, parts = conversations.repair(conversations.damage(rows))
    digest = conversations.digests(parts)
    every = rows.select("conv_id").distinct()
    joined = join_null_safe(join_null_safe(every, found, ["conv_id"], "left"), digest, ["conv_id"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens by two vocabularies, their groups and links, and the links' counts over the corpus."""
    return alignment.cross_alignment(table(spark, sf_dir, "documents"))[0]


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their shingle set and the component of their links."""
    found, _ = ngramjoin.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES = {
    "op1_secret_markov": op1_secret_markov,
    "op2_warc_merkle": op2_warc_merkle,
    "op3_line_minhash": op3_line_minhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_prefix_shards": op5_byte_prefix_shards,
    "op6_recompression_repeats": op6_recompression_repeats,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_benchmark_automaton": op8_benchmark_automaton,
    "op9_piece_lattice": op9_piece_lattice,
    "op10_url_logistic": op10_url_logistic,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_ngram_join": op13_ngram_join,
}

_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS spaces, length(t) AS n_all,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: length(x) > 40)) AS n_long_words,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, n_all - spaces AS word_chars,
         CASE WHEN n_words < 50 THEN 1 ELSE 0 END
         | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END AS base_bits
  FROM m),
f AS (
  SELECT *, base_bits
         | CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
         | CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END
         | CASE WHEN 10 * n_dup_lines > 8 * n_lines THEN 16 ELSE 0 END
         | CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END
         | CASE WHEN 10 * n_long_words > n_words THEN 64 ELSE 0 END AS bits
  FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_bits <> 0 AS base_failed, bits = 0 AS kept,
       CAST(bits AS BIGINT) AS fail_bits, base_bits = 0 AS kept_base_1
FROM f
"""

_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, dw.size AS size, i, item FROM dw JOIN win ON dw.g = win.g AND dw.size = win.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
""".replace(
    "lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
word AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op4_quality_rules": _OP4_SQL, "op6_recompression_repeats": _OP6_SQL, "op8_benchmark_automaton": _OP8_SQL}
