"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every larger (large), or every smaller and itself, neighbour of a node to the least node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, root: the smallest node of each linked node's component, by alternating large and small stars.

    links: u, v. Each round's table is written to the shared folder. Minima are partial aggregates, so a node with very many
    neighbours is no single task's; nodes without links aren't returned. Rounds grow with the logarithm of the longest path; a
    table that still changes after ``most`` of them is an error.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sums = None
    for _ in range(most):
        now = cut(_star(_star(now, True), False))
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max(F.lit(1))).first()
        if got == sums:
            break
        sums = got
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
