"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.sources.lineage import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself: the larger neighbours, or the smaller ones and itself."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    ).where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """`a, b`: every node of `links` (a, b) that is not the smallest of its component, and that smallest node.

    Each round writes its links to the shared folder. The driver sees a count and a checksum of them, to know when
    nothing changes any more.
    """
    now = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut_lineage(_star(_star(now, True), False))
    return now
