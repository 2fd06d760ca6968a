"""Fixity audit of WARC replicas by Merkle trees over offset ranges.

A replica is a table of records: ``file, offset, record`` (bytes as stored). Leaves are
the SHA-256 of records; a node of level 0 covers the records that begin in one range of
``range_bytes`` of a file, in offset order, and a node of level k covers ``fanout`` nodes
of level k - 1. A file's root is its only node of the top level, where one range covers
the whole file. Equal roots prove equal files. Where roots differ, the audit descends:
of each level, only children of differing nodes are compared, down to records.

No file is ever gathered: a node joins at most ``fanout`` children, and a range's records
are bounded by its bytes. So one huge file is many nodes, and no sort runs over a file.

Defined results: a null record hashes like no bytes but differs from an empty one; rows
with a null file or offset are not part of a replica; repeated records (equal offsets)
are hashed in the order of their hashes, so a record that is there twice is found as a
difference; empty replicas are equal to each other, and against an empty replica every
record is missing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.llm.common import text_of
from sitemarks.operators.ordered import with_running_totals
from sitemarks.session import written

RANGE_BYTES = 1 << 16
FANOUT = 16


def warc_rows(pages: DataFrame, pages_per_file: int = 5000) -> DataFrame:
    """Pages as WARC/1.0 resource records: ``file, page_id, record``. Pages with a null id are left out: a record needs a name."""
    body = F.encode(text_of("html"), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return pages.filter("page_id IS NOT NULL").select(
        F.concat(F.lit("pages-"), F.floor(F.col("page_id") / pages_per_file).cast("string"), F.lit(".warc")).alias("file"),
        "page_id", record.alias("record"),
    )


def with_offsets(rows: DataFrame) -> DataFrame:
    """Add ``offset`` to ``file, page_id, size`` and more: where a record begins, with pages in order per file.

    Rows should be narrow (digests, not records). Repeated ids lie side by side by size.
    """
    copies = Window.partitionBy("file", "page_id").orderBy("size")
    numbered = rows.withColumn("copy", F.row_number().over(copies))
    ends = with_running_totals(numbered, ["file"], ["page_id", "copy"], {"until": F.col("size")})
    return ends.withColumn("offset", F.col("until") - F.col("size")).drop("until")


def warc_records(pages: DataFrame, pages_per_file: int = 5000) -> DataFrame:
    """``file, offset, page_id, record``: the records with their bytes and places."""
    rows = warc_rows(pages, pages_per_file)
    size = F.length("record").cast("long")
    places = with_offsets(rows.select("file", "page_id", size.alias("size")))
    copies = Window.partitionBy("file", "page_id").orderBy(F.length("record"))
    numbered = rows.withColumn("copy", F.row_number().over(copies))
    return numbered.join(places, ["file", "page_id", "copy"]).select("file", "offset", "page_id", "record")


def digest(record: Column | str = "record") -> Column:
    """The hash of a record's bytes; a missing record has one of its own."""
    return F.coalesce(F.sha2(record, 256), F.lit("null"))


def _leaves(records: DataFrame) -> DataFrame:
    """``file, offset, hash`` of each record; a replica may bring digests as ``hash`` in place of records."""
    own = records.filter("file IS NOT NULL AND offset IS NOT NULL")
    found = digest() if "record" in records.columns else F.col("hash")
    return own.select("file", "offset", found.alias("hash"))


def _joined(children: DataFrame, node: Column) -> DataFrame:
    """Nodes from children ``file, place, hash``: the hash of their places and hashes in order."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "hash")))
    named = F.transform(ordered, lambda c: F.concat_ws(":", c["place"], c["hash"]))
    return children.groupBy("file", node.alias("node")).agg(F.sha2(F.array_join(named, "\n"), 256).alias("hash")).withColumnRenamed("node", "place")


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Leaves, then nodes of level 0 to ``levels``: each ``file, place, hash``, written once."""
    leaves = written(_leaves(records).withColumnRenamed("offset", "place"), "fixity-leaves")
    out = [leaves, written(_joined(leaves, F.floor(F.col("place") / range_bytes)), "fixity-0")]
    for k in range(1, levels + 1):
        out.append(written(_joined(out[-1], F.floor(F.col("place") / fanout)), f"fixity-{k}"))
    return out


def levels_of(replicas: list[DataFrame], range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels until one node covers the longest file of any replica."""
    furthest = max([r.agg(F.max("offset")).first()[0] or 0 for r in replicas], default=0)
    place, levels = furthest // range_bytes, 0
    while place:
        place //= fanout
        levels += 1
    return levels


def audit(one: DataFrame, two: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Roots and differences of two replicas.

    Roots: ``file, root_one, root_two, equal``. Differences: ``file, offset, hash_one,
    hash_two`` of every record that is not the same in both; a hash is null where the
    record is missing, and repeated records are compared as sorted lists.
    """
    levels = levels_of([one, two], range_bytes, fanout)
    first, second = tree(one, levels, range_bytes, fanout), tree(two, levels, range_bytes, fanout)
    roots = _both(first[-1], second[-1]).select(
        "file", F.col("one").alias("root_one"), F.col("two").alias("root_two"), F.col("one").eqNullSafe(F.col("two")).alias("equal")
    )
    wrong = _both(first[-1], second[-1]).filter(~F.col("one").eqNullSafe(F.col("two"))).select("file", F.col("place").alias("up"))
    for k in range(levels, -1, -1):
        # first[k] holds the children of the nodes in first[k + 1].
        step = fanout if k else range_bytes
        parts = [_below(side[k], wrong, step, records=not k) for side in (first, second)]
        differ = _both(*parts).filter(~F.col("one").eqNullSafe(F.col("two")))
        if k:
            wrong = written(differ.select("file", F.col("place").alias("up")), "fixity-wrong")
    return roots, differ.select("file", F.col("place").alias("offset"), F.col("one").alias("hash_one"), F.col("two").alias("hash_two"))


def _below(nodes: DataFrame, wrong: DataFrame, step: int, records: bool) -> DataFrame:
    own = nodes.withColumn("up", F.floor(F.col("place") / step)).join(wrong, ["file", "up"], "left_semi").select("file", "place", "hash")
    if records:
        own = own.groupBy("file", "place").agg(F.array_join(F.sort_array(F.collect_list("hash")), "+").alias("hash"))
    return own


def _both(one: DataFrame, two: DataFrame) -> DataFrame:
    left = one.select("file", "place", F.col("hash").alias("one"))
    return left.join(two.select("file", "place", F.col("hash").alias("two")), ["file", "place"], "full")


def faulty(record: str = "record", page_id: str = "page_id", every: int = 20) -> tuple[Column, Column]:
    """A record with a known fault by the hash of its page's id, and whether it is lost altogether.

    Of ``3 * every`` records about one has a flipped byte, one is cut, and one is lost.
    """
    fault = F.pmod(F.xxhash64(page_id), F.lit(3 * every))
    half = f"cast(floor(length({record}) / 2) as int)"
    letter = F.hex(F.expr(f"substring({record}, {half} + 1, 1)"))
    head = F.expr(f"substring({record}, 1, {half})")
    flipped = F.concat(head, F.unhex(F.when(letter == "58", "59").otherwise("58")), F.expr(f"substring({record}, {half} + 2)"))
    long = F.length(record) > 1
    return F.when((fault == 0) & long, flipped).when((fault == 1) & long, head).otherwise(F.col(record)), fault == 2


def damaged(records: DataFrame, every: int = 20) -> DataFrame:
    """A replica of records with known faults."""
    record, lost = faulty(every=every)
    return records.filter(~lost).withColumn("record", record)
