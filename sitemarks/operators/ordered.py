"""Ordered operators that survive one huge group.

A plain window sends each group to one task. Here a group is cut into slices of
about equal size by range partitioning on its order, and what a slice needs from
the slices before it is carried over as a few extra rows:

* running totals: one seed row per slice with the sum of everything before it,
* look-back frames: the last rows of the preceding slices (a halo).

Slices are numbered once and written to the shared folder, because a range
partitioning that is evaluated twice may choose different bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemarks.session import written

ROWS_PER_SLICE = 1_000_000
SMALLEST_SLICE = 1_000
SLICE = "slice_no"
#: Row kinds of a prepared table, in the order they sort within a slice.
SEED, HALO, ROW = 0, 1, 2


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Like ``left.join(right, keys, how)``, but NULL keys are equal to each other, as they are in a group."""
    own = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(own)
    equal = [left[k].eqNullSafe(renamed[r]) for k, r in own.items()]
    return left.join(renamed, equal, how).drop(*own.values())


def slice_rows(df: DataFrame, group: list[str], order: list[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Number the slices: rows sorted by ``group, order`` get an increasing ``slice_no``.

    The order must be total within a group. There are at least as many slices as
    ``rows_per_slice`` asks for, and beyond that enough to keep the shuffle
    partitions busy, but none of just a few rows.
    """
    rows = df.count()
    busy = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALLEST_SLICE))
    slices = max(1, busy, -(-rows // rows_per_slice))
    ranged = df.repartitionByRange(slices, *group, *order).withColumn(SLICE, F.spark_partition_id())
    return written(ranged, "slices")


def slice_totals(sliced: DataFrame, group: list[str], measures: dict[str, Column]) -> DataFrame:
    """Per slice of a group: its sums and, as ``<name>_before``, the sums of all slices before it.

    The window here runs over slices, not rows: a group has at most as many as there are partitions.
    """
    sums = sliced.groupBy(*group, SLICE).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in measures]
    )


def with_running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    measures: dict[str, Column],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add running sums (current row included) of the measures within each group."""
    sliced = slice_rows(df, group, order, rows_per_slice)
    totals = slice_totals(sliced, group, measures)
    steps = {f"_step_{n}": c for n, c in measures.items()}
    rows = sliced.withColumns({**steps, "_kind": F.lit(ROW)})
    seeds = totals.select(
        *group, SLICE, F.lit(SEED).alias("_kind"), *[F.col(f"{n}_before").alias(f"_step_{n}") for n in measures]
    )
    in_slice = (
        Window.partitionBy(*group, SLICE).orderBy("_kind", *order).rowsBetween(Window.unboundedPreceding, 0)
    )
    both = rows.unionByName(seeds, allowMissingColumns=True)
    sums = [F.sum(f"_step_{n}").over(in_slice).alias(n) for n in measures]
    return both.select(*df.columns, "_kind", *sums).filter(F.col("_kind") == ROW).drop("_kind")


def with_row_number(df: DataFrame, group: list[str], order: list[str], out: str = "row_no") -> DataFrame:
    """``row_number`` over groups of any size."""
    return with_running_totals(df, group, order, {out: F.lit(1)})


def with_lookback(
    sliced: DataFrame,
    group: list[str],
    order: list[str],
    back: int,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Sliced rows plus, per slice, its halo of ``back`` preceding rows and its seed row.

    Returns the columns of ``sliced`` with ``_kind`` and ``<name>_before`` columns
    (seed rows only). Within a slice, order by ``_kind`` first. Frames of up to
    ``back`` preceding rows computed per slice equal those over the whole group.
    """
    measures = {"_rows": F.lit(1), **(measures or {})}
    totals = slice_totals(sliced, group, measures)
    # Which later slices reach back into this one: usually the next, more when slices are tiny.
    ahead = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(1, back)
    end = F.col("_rows_before") + F.col("_rows")
    reach = totals.select(
        *group,
        SLICE,
        end.alias("_end"),
        F.collect_list(F.struct(F.col(SLICE).alias("to"), F.col("_rows_before").alias("start"))).over(ahead).alias("_to"),
    )
    latest_first = Window.partitionBy(*group, SLICE).orderBy(*[F.col(c).desc() for c in order])
    tails = sliced.withColumn("_rank", F.row_number().over(latest_first)).filter(F.col("_rank") <= back)
    position = F.col("_end") - F.col("_rank") + 1
    halo = (
        join_null_safe(tails, reach, [*group, SLICE])
        .withColumn("_target", F.explode("_to"))
        .filter(position > F.col("_target.start") - back)
        .withColumn(SLICE, F.col("_target.to"))
        .select(*sliced.columns, F.lit(HALO).alias("_kind"))
    )
    seeds = totals.select(*group, SLICE, F.lit(SEED).alias("_kind"), *[f"{n}_before" for n in measures])
    rows = sliced.withColumn("_kind", F.lit(ROW))
    return rows.unionByName(halo).unionByName(seeds, allowMissingColumns=True)
