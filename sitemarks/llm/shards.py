"""Balanced contiguous shards by a global prefix sum of byte sizes (native).

Rows are put in order of their id by range partitioning. Each partition's total is
summed, the totals' prefix sums (one row per partition) tell where a partition begins
in the corpus, and a running sum inside each partition does the rest. A row belongs to
the shard in whose share of all bytes its middle lies, so shards are contiguous in
order and a shard's size differs from the equal target by at most one row at each cut.

The order is total: id, then checksum and size of the text, then the row's place in the
input. So neither a frequent id nor repeated rows fall into one partition together.

Defined results: a null text has size 1 (no bytes, one separator) and the checksum of
no bytes; null ids come first; repeated rows get places of their own; fewer rows than
shards leave shards empty; an empty table gives an empty table; extra columns are left
out by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.llm.common import text_of
from sitemarks.session import written

SHARDS = 8
#: Rows per range partition that the running sums are made over, at most about.
ROWS_PER_PART = 1_000_000


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes and one separator."""
    return (F.octet_length(text_of(text)) + 1).cast("long")


def cut(start: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard of a row that takes ``size`` bytes from ``start`` on: where its middle lies.

    In integers: floor((2 * start + size) * shards / (2 * total)).
    """
    wide = lambda c: c.cast("decimal(38,0)")
    middle = (wide(2 * start + size) * shards).cast("decimal(38,0)")
    whole = F.floor(middle / wide(2 * total)).cast("int")
    return F.least(whole, F.lit(shards - 1))


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    rows_per_part: int = ROWS_PER_PART,
    place: Column | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, place``: one row per input row; slots count from 0 in a shard.

    ``place`` tells rows apart that are equal otherwise: by default their place in the scan.
    """
    place = F.monotonically_increasing_id() if place is None else place
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), text_size(text).alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"), place.alias("place"),
    )
    # Texts are read once: from here on a row is four numbers. The written place stays what it is.
    sized = written(rows, "shard-sizes")
    order = ["doc_id", "text_crc32", "size", "place"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // rows_per_part))
    # Written, as a range partitioning that is evaluated twice may choose other bounds.
    ranged = written(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-parts")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    # One row per partition: their number is bounded by rows / rows_per_part and the session's partitions.
    begins = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begin"), F.sum("bytes").over(Window.partitionBy()).alias("total")
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(begins, "part").withColumn("start", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cuts = written(placed.withColumn("shard", cut(F.col("start"), F.col("size"), F.col("total"), shards)), "shard-cuts")

    counts = cuts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)) - 1
    return cuts.join(slots, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + number).cast("long").alias("slot"), "place"
    )


def shard_sizes(assigned: DataFrame) -> DataFrame:
    """``shard, rows, bytes`` of an assignment."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """The rows themselves, as one folder ``shard=N`` each, in slot order within each file; every row once, repeated ones too.

    The rows are written with their places first, so that each is found again by a number of its own.
    Columns named ``shard`` and ``slot`` are replaced.
    """
    rows = written(docs.drop("shard", "slot").withColumn("_llm_place", F.monotonically_increasing_id()), "shard-rows")
    found = assign(rows, shards, doc_id, text, place=F.col("_llm_place")).select(F.col("place").alias("_llm_place"), "shard", "slot")
    joined = rows.join(found, "_llm_place").drop("_llm_place")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
