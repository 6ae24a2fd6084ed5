"""Shards on a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only)."""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Places of the ring. Counts are taken by place, so what the driver plans with is bounded by this, whatever the input.
PLACES = 1 << 16
#: Rows of one place that one task numbers, about; rows that are broadcast at most.
CROWD, SMALL = 200_000, 500_000


def ring(shards: int, virtual_nodes: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in clockwise order. A node's place depends on its shard and number alone; of two at one place the later moves on to the next free one."""
    taken: dict[int, int] = {}
    for v in range(virtual_nodes):
        for s in range(shards):
            p = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % places
            while p in taken:
                p = (p + 1) % places
            taken[p] = s
    return sorted(taken.items())


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int, slack: float = 0.0, places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """(place, from rank, to rank, shard, first slot): where the keys of each place go.

    Keys go to the next node clockwise. A shard takes at most its capacity: a fair share of the keys, times 1 + slack,
    the first shards one more where shares aren't whole. What a full shard can't take goes on to the next node, and so on:
    in round d all arcs offer what they have left to their d-th node, in ring order.
    """
    total = sum(counts.values())
    fair = int(total * (1 + slack)) if slack else total
    room = [fair // shards + (s < fair % shards) for s in range(shards)]
    filled = [0] * shards
    arcs: dict[int, deque] = defaultdict(deque)
    at = 0
    for p in range(places):  # an arc: the places after one node up to the next
        while at < len(nodes) and nodes[at][0] < p:
            at += 1
        if counts.get(p):
            arcs[at % len(nodes)].append([p, 0, counts[p]])
    out, d = [], 0
    while arcs:
        for a in sorted(arcs):
            s, queue = nodes[(a + d) % len(nodes)][1], arcs[a]
            while queue and filled[s] < room[s]:
                p, lo, hi = queue[0]
                n = min(hi - lo, room[s] - filled[s])
                out.append((p, lo, lo + n, s, filled[s]))
                filled[s] += n
                queue[0][1] += n
                if queue[0][1] == hi:
                    queue.popleft()
        arcs = {a: q for a, q in arcs.items() if q}
        d += 1
    return out


def place(key, places: int = PLACES):
    """Column: a key's place on the ring."""
    return F.pmod(F.xxhash64(key), F.lit(places)).cast("int")


def shard(df: DataFrame, shards: int, key: str = "doc_id", order: list[str] | None = None, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """df with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Counts by place are the only thing the driver sees: at most PLACES of them; the plan has a row for each place and
    one more for each arc that is split, so the broadcast side is bounded by PLACES + rounds * virtual nodes rows. A place with
    more than CROWD rows, as one key that many rows have, is numbered in groups by a hash of key and ``order``.
    With slack 0 the shards' counts differ by one at most. Rows with equal keys are told apart by ``order``; a null key
    is a key like any other; no rows give no rows. Columns of df keep their names; shard and slot replace columns so named. df is
    read several times: give a written table.
    """
    nodes = ring(shards, virtual_nodes)
    spark = df.sparkSession
    own = [F.col(c) for c in [key, *(order or [])]]
    counts = {r[0]: r[1] for r in df.groupBy(place(F.col(key)).alias("p")).count().collect()}
    rows = plan(counts, nodes, shards, slack)
    assigned = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "_p int, _lo long, _hi long, shard int, _base long")
    crowds = spark.createDataFrame([(p, -(-n // CROWD)) for p, n in sorted(counts.items())] or [(0, 1)], "_c int, _groups int")
    placed = df.drop("shard", "slot").withColumn("_place", place(F.col(key))).join(F.broadcast(crowds), F.col("_place") == F.col("_c"))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*own), F.col("_groups")).cast("int")).drop("_c", "_groups")
    before = Window.partitionBy("_bp").orderBy("_bs").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(F.col("_place").alias("_bp"), F.col("_salt").alias("_bs")).agg(F.count(F.lit(1)).alias("_m")).withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    # The first group of a place begins at 0; there is a row here for the others alone, one for CROWD rows of df.
    firsts = cut(sizes.where("_first > 0").select("_bp", "_bs", "_first"))
    firsts = F.broadcast(firsts) if firsts.limit(SMALL + 1).count() <= SMALL else firsts
    by = Window.partitionBy("_place", "_salt").orderBy(F.xxhash64(F.col(key)), *own)
    ranked = placed.withColumn("_n", F.row_number().over(by) - 1).join(firsts, (F.col("_place") == F.col("_bp")) & (F.col("_salt") == F.col("_bs")), "left")
    ranked = ranked.withColumn("_rank", (F.coalesce("_first", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_bp", "_bs", "_first", "_salt")
    joined = ranked.join(F.broadcast(assigned), (F.col("_place") == F.col("_p")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return joined.withColumn("slot", F.col("_base") + F.col("_rank") - F.col("_lo")).drop("_place", "_rank", "_p", "_lo", "_hi", "_base")


def shard_documents(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """Each document's shard under the law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32: of those bytes (null: of none).
    The documents' count decides the capacities, so grown_shard, which the law ``key`` alone has, is null. Repeated ids and null
    ones are keys like others, equal rows take slots of their own; other columns aren't read; no rows give no rows.
    """
    slim = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    out = shard(cut(slim), shards, order=["size", "text_crc32", "row"], virtual_nodes=virtual_nodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
