"""Written shards hold every row once, and the query's columns are those of a plain pass."""

import zlib
from collections import Counter

from sitemarks.llm import shards
from sitemarks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, f"text {i % 3}" if i % 4 else None, i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot int").selectExpr("*", "'x' AS size", "1 AS place")
    shards.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.size, r.place) for r in back.collect()) == Counter((i, t, "x", 1) for i, t, _ in rows)
    slots = {}
    for r in back.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {k: sum(len(r.text or "") + 1 for r in back.filter(f"shard = {k}").collect()) for k in slots}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 7
    shards.write_shards(docs.limit(0), str(tmp_path / "none"))


def test_query_equals_a_plain_pass(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    total, at, count, expected = sum(len(t.encode()) + 1 for _, t in docs), 0, Counter(), []
    for i, text in docs:
        size = len(text.encode()) + 1
        shard = min(7, (2 * at + size) * 8 // (2 * total))
        expected.append((i, size, zlib.crc32(text.encode()), "bytes", shard, count[shard], None))
        at, count[shard] = at + size, count[shard] + 1
    got = QUERIES["op5_byte_prefix_shards"](spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.collect())) == expected
