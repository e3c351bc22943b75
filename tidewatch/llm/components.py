"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, written

#: Links that a task of a round holds, about, where there are few: else each round would write very many small files.
LINKS = 20_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _near_smallest(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are linked to the smallest node around it instead."""
    near = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    out = spread_join(near, low, "a") if large else near.join(low, "a")  # the centre of a large star is a hot key
    if large:
        moved = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each link leads to a centre: no node has two smaller neighbours, or is a smaller and a larger one."""
    nodes = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    nodes = nodes.unionByName(links.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    got = nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return got.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node with a link; the component is the smallest node reachable.

    links has columns a and b. Each round is written to the shared folder; rounds go as the logarithm of the longest path.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = now.count() // LINKS + 1  # rounds don't add links
    while not _stars(now):
        after = written(_near_smallest(_near_smallest(now, True), False).coalesce(tasks))
        dropped(now)
        now = after
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
