"""Connected components of a link table, as a distributed union-find.

Rounds of star contraction: every node hands its larger neighbours to its smallest
one, then every node hands its smaller neighbours to the smallest of them. Each round
is two aggregations with map-side combine and two joins, and rounds end when all is stars; nothing is gathered per
node, so a node with millions of links is no different from others. Each round's
links are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemarks.session import written


def _done(links: DataFrame) -> bool:
    """Whether every larger end has one link, to an end that is no larger one itself: whole components, one star each."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.filter(F.col("up") + F.col("down") > F.greatest(F.lit(1), "down")).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.filter(F.col("b") > F.col("a"))
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Here b < a in every row.
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    moved = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(kept).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the links; the root is the smallest node of its component.

    Links between long ids, in any direction, repeated or not. A link of a node to
    itself makes it a component of its own; rows with a null end are no links. No
    links give no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    own = written(ends.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    now = written(
        own.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while not _done(now):
        now = written(_small_star(_large_star(now)), "links")
    # Now every node but the roots has one row, with its root.
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    alone = own.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))
