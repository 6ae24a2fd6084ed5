"""Edges (relation, src, dst, weight): neighbours and breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import kept, placed

#: Levels of so many keys at most get their places in one task; larger ones by a distributed sort.
FEW = 100_000

EDGES = "relation string, src string, dst string, weight double"


def neighbors(edges: DataFrame, key, relation: str) -> DataFrame:
    return edges.where((F.col("relation") == relation) & (F.col("src") == key)).select(F.col("dst").alias("key")).distinct().orderBy("key")


def neighbors_weighted(edges: DataFrame, key, relation: str) -> DataFrame:
    rows = edges.where((F.col("relation") == relation) & (F.col("src") == key))
    return rows.select(F.col("dst").alias("key"), F.coalesce("weight", F.lit(1.0)).alias("weight")).orderBy("key")


def in_neighbors(edges: DataFrame, key, relation: str) -> DataFrame:
    return edges.where((F.col("relation") == relation) & (F.col("dst") == key)).select(F.col("src").alias("key")).distinct().orderBy("key")


def traverse(edges: DataFrame, start, relation: str, hops: int) -> DataFrame:
    """key, hop, place of what is reached within so many hops, without the start: by level, then the finder's place, then key.

    Each level is one join of the frontier with the relation's edges and is written to the shared folder, so it is computed
    once, survives lost executors, and has a known size, by which Catalyst broadcasts a small frontier and shuffles a large one.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    mine = edges.where(F.col("relation") == relation).select("src", "dst")
    seen = spark.range(1).select(F.lit(start).cast(kind).alias("key"))
    frontier, out = seen.withColumn("place", F.lit(0).cast("long")), None
    for hop in range(1, hops + 1):
        # The first frontier is one row.
        near = F.broadcast(frontier) if hop == 1 else frontier
        found = mine.join(near, F.col("src") == F.col("key")).groupBy(F.col("dst").alias("key")).agg(F.min("place").alias("parent")).join(seen, "key", "left_anti")
        found = kept(found)
        n = found.count()
        if not n:
            break
        if n <= FEW:
            level = found.select("key", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("parent", "key")).cast("long").alias("place"))
        else:
            level = placed(found.orderBy("parent", "key").select("key"))
        rows = level.select("key", F.lit(hop).alias("hop"), "place")
        out = rows if out is None else out.unionByName(rows)
        seen, frontier = seen.unionByName(level.select("key")), level
    return spark.createDataFrame([], f"key {kind}, hop int, place long") if out is None else out.orderBy("hop", "place")


def reachable(edges: DataFrame, start, relation: str, hops: int) -> DataFrame:
    """key, hop: reachability in one recursive query, without the order of discovery."""
    spark = edges.sparkSession
    edges.where(F.col("relation") == relation).createOrReplaceTempView("_edges_of")
    text = start if isinstance(start, (int, float)) else "'" + str(start).replace("'", "''") + "'"
    return spark.sql(f"""
        WITH RECURSIVE r(key, hop) AS (
          SELECT CAST({text} AS {edges.schema["src"].dataType.simpleString()}), 0
          UNION ALL SELECT e.dst, r.hop + 1 FROM r JOIN _edges_of e ON e.src = r.key WHERE r.hop < {int(hops)})
        SELECT key, min(hop) AS hop FROM r GROUP BY key HAVING min(hop) > 0""")


def without_key(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """edges less those that touch one of keys (column ``key``)."""
    return edges.join(keys.select(F.col("key").alias("src")), "src", "left_anti").join(keys.select(F.col("key").alias("dst")), "dst", "left_anti").select("relation", "src", "dst", "weight")
