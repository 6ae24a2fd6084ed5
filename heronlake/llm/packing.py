"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, slices
from .tokens import encoder

#: A group of (length, salt) has about so many pieces at most; fewer on small inputs, so that groups spread.
GROUP, GROUPS = 100_000, 1024
#: A plan of more rows than this is joined by a shuffle.
SMALL_PLAN = 200_000


def pieces(docs: DataFrame, tokenizer: str, longest: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit): each document's ids and the end id, cut after every ``longest`` ids."""
    ship(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut_up(batches):
        code, end = encoder(tokenizer), struct.pack("<I", end_id)
        for b in slices(batches):
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), code.encode_many(b.column(1)), strict=True):
                ids += end
                if len(ids) <= 4 * longest:
                    rows.append((d, 0, 0, len(ids) // 4, zlib.crc32(ids), ids))
                else:
                    for k, i in enumerate(range(0, len(ids), 4 * longest)):
                        x = ids[i : i + 4 * longest]
                        rows.append((d, k, i // 4, len(x) // 4, zlib.crc32(x), x))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], types[k]) for k in range(len(names))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, kind)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset, in each): a best-fit-decreasing packing of counts.

    Pieces of a length with ranks from ``lo`` to ``hi`` fill sequences in a row, ``in each`` of them in every one, from the offset on.
    Bins of equal contents are one group with a count, so the work and the plan depend on the number of different lengths, not on that of pieces.
    """
    out, bins = [], 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, bins)
    rooms: list[int] = []  # sorted rooms that have groups

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, lo = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, lo, lo + full * each, first, capacity - room, each))
                put(room - full and room - each * length, first, full)
                lo, left = lo + full * each, left - full * each
            if left and full < n:
                out.append((length, lo, lo + left, first + full, capacity - room, left))
                put(room - left * length, first + full, 1)
                full, lo, left = full + 1, lo + left, 0
            put(room, first + full, n - full)
    return out


def place(cuts: DataFrame, capacity: int, row: str | None = None) -> DataFrame:
    """cuts (with doc_id, piece, length) with sequence_id and offset. Its rows are read several times: give a written table.

    Ranks within a length come from counts by (length, salt), the salt spreading lengths that many pieces share, and a number within that group;
    each piece then takes the slot that the plan has for its length and rank. Repeated rows are pieces of their own; ``row`` names a
    column that tells them apart, so that many equal ones are spread too. The driver sees counts by length, ``capacity`` at most, and the plan over them.
    """
    spark = cuts.sparkSession
    counts = {int(r[0]): int(r[1]) for r in cuts.groupBy("length").count().collect()}
    total = sum(counts.values())
    group = min(GROUP, max(1, -(-total // GROUPS)))
    salts = [1] * (capacity + 1)
    for k, n in counts.items():
        salts[k] = -(-n // group)
    length, own = F.col("length").cast("int"), [row] if row else ["doc_id", "piece", "ids_crc32"]
    salted = cuts.withColumn("_salt", F.pmod(F.xxhash64(*own), F.element_at(F.lit(salts), length + 1)).cast("int"))
    before = Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(length.alias("_l"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    base = cut(sizes.select("_l", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    slots = best_fit(counts, capacity)
    rows_of: dict[int, int] = defaultdict(int)
    for x in slots:
        rows_of[x[0]] += 1
    # A length's plan rows are spread over blocks of ranks, about one row to a block, and a block has GROUP ranks at most.
    step = [1] * (capacity + 1)
    for k, n in counts.items():
        step[k] = max(1, min(group, n // rows_of[k]))
    blocks = sum((hi - 1) // step[k] - lo // step[k] + 1 for k, lo, hi, *_ in slots)
    plan = spark.createDataFrame(slots or [(0, 0, 0, 0, 0, 0)], "_k int, _lo long, _hi long, _first long, _off long, _each long")
    wide = F.element_at(F.lit(step), F.col("_k") + 1)
    plan = plan.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / wide), F.floor(F.greatest(F.col("_hi") - 1, F.col("_lo")) / wide))))
    small = F.broadcast if blocks + sum(salts[k] for k in counts) <= SMALL_PLAN else (lambda x: x)
    by = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_n", F.row_number().over(by) - 1).join(small(base), (length == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_base") + F.col("_n"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / F.element_at(F.lit(step), length + 1)).cast("long"))
    taken = ranked.join(small(plan), (length == F.col("_k")) & (F.col("_block") == F.col("_b")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    j = F.col("_rank") - F.col("_lo")
    kept = [F.col(c) for c in cuts.columns if c != row]
    return taken.select(*kept, (F.col("_first") + F.floor(j / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_off") + (j % F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place there. Null text is an empty document, which has the end id alone; no rows give no rows.

    Repeated rows and those without an id are pieces of their own; columns other than doc_id and text aren't read.
    """
    found = pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id())
    return place(cut(found), capacity, "_row")
