"""Token-ID files of bit or byte planes.

A file: MAGIC, chunks, the document table, the chunk index, and a footer with their places.
A chunk: up to BLOCK ids, transposed to 4 byte planes or 32 bit planes, each compressed with zstandard; a plane of zeros has no bytes.
Index: for each chunk its place, number of ids and the planes' lengths, so any chunk can be read by itself.
Document table: doc ids (with a flag for null) and token counts in file order, in sections of SECTION documents.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, parts, scratch, ship, slices
from .tokens import encoder

MAGIC, FOOT = b"HLPLANE1", struct.Struct("<QQ8s")
BLOCK, SECTION, LEVEL = 1 << 16, 1 << 16, 1


def shuffle_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """ids as planes: 4 of bytes, or 32 of bits (the bits of a plane packed in order)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def join_planes(found: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        raw = np.empty((n, 4), np.uint8)
        for k, x in enumerate(found):
            raw[:, k] = np.frombuffer(x, np.uint8)
        return raw.view("<u4").reshape(-1)
    bits = np.empty((n, 32), np.uint8)
    for k, x in enumerate(found):
        bits[:, k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes documents one after the other; holds a block of ids and a section of the document table at most."""

    def __init__(self, out, planes: str = "byte", block: int = BLOCK):
        self.out, self.planes, self.block = out, planes, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.held_bytes, self.index, self.sections = [], 0, [], []
        self.docs, self.counts, self.at, self.n_docs, self.n_ids = [], [], 0, 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, everything: bool) -> None:
        data, step = b"".join(self.held), self.block * 4
        last = len(data) if everything else len(data) // step * step
        for i in range(0, last, step):
            ids = np.frombuffer(data[i : min(i + step, last)], "<u4")
            zipped = [self.zip.compress(x) if any(x) else b"" for x in shuffle_planes(ids, self.planes)]
            self.index.append([self.at, len(ids), *map(len, zipped)])
            self._put(b"".join(zipped))
        self.held, self.held_bytes = [data[last:]], len(data) - last

    def _section(self) -> None:
        if self.docs:
            known = np.array([d is not None for d in self.docs], np.uint8)
            data = known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes()
            self.sections.append([self.at, len(self.docs), len(x := self.zip.compress(data))])
            self._put(x)
            self.docs, self.counts = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_docs += 1
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.block * 4 * 4:
            self._flush(False)
        if len(self.docs) == SECTION:
            self._section()

    def close(self) -> None:
        self._flush(True)
        self._section()
        head = self.zip.compress(json.dumps({"planes": self.planes, "block": self.block, "chunks": self.index, "sections": self.sections, "n_docs": self.n_docs, "n_ids": self.n_ids}).encode())
        at = self.at
        self._put(head)
        self._put(FOOT.pack(at, len(head), MAGIC))


class Reader:
    """Reads a file's index; then chunks, or documents in order, a chunk at a time."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2) or source.tell()
        at, n, magic = FOOT.unpack(self._get(size - FOOT.size, FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a plane file, or one that was cut short")
        self.head = json.loads(self.unzip.decompress(self._get(at, n)))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lengths = self.head["chunks"][k]
        data, found, i = self._get(at, sum(lengths)), [], 0
        empty = bytes(n if self.head["planes"] == "byte" else (n + 7) // 8)
        for x in lengths:
            found.append(self.unzip.decompress(data[i : i + x]) if x else empty)
            i += x
        return join_planes(found, n, self.head["planes"])

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(doc_id, its ids as slices of chunks)."""
        chunk, k, used = np.zeros(0, "<u4"), 0, 0
        for at, n, size in self.head["sections"]:
            data = self.unzip.decompress(self._get(at, size))
            known = np.frombuffer(data, np.uint8, n)
            ids, counts = np.frombuffer(data, "<i8", n, n), np.frombuffer(data, "<u8", n, 9 * n)
            for ok, doc, left in zip(known.tolist(), ids.tolist(), counts.tolist(), strict=True):
                out = []
                while left:
                    if used == len(chunk):
                        chunk, k, used = self.chunk(k), k + 1, 0
                    out.append(chunk[used : used + left])
                    used += len(out[-1])
                    left -= len(out[-1])
                yield doc if ok else None, out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, planes: str = "byte") -> list[dict]:
    """Encodes doc_id and text into files of the format under path (any store that pyarrow.fs opens), ids in ascending doc_id order.

    Returns the manifest in that order: file, documents, ids (a row for each file). Ties of doc_id are ordered by a hash of the text and then as the
    input has them, so that many rows of one id, or without one, make several files; null ids come first; null text is empty. Columns other than doc_id and
    text aren't read.
    A task writes its file under a name of its own and moves it when it is whole, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = slim.repartitionByRange(parts(slim), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def files(batches):
        code, end, out = encoder(tokenizer), struct.pack("<I", end_id), None
        fs, top = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"{top}/part-{task.partitionId():06d}.hlp"
        for b in slices(batches):
            if b.num_rows and out is None:
                fs.create_dir(top, recursive=True)
                raw = fs.open_output_stream(tmp := f"{top}/_part-{task.partitionId():06d}-{task.taskAttemptId()}")
                out = Writer(raw, planes)
            for d, ids in zip(b.column(0).to_pylist(), code.encode_many(b.column(1)), strict=True):
                out.add(d, ids + end)
        if out:
            out.close()
            raw.close()
            fs.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"k": pa.array([task.partitionId()], pa.int32()), "file": [name.rpartition("/")[2]], "documents": pa.array([out.n_docs], pa.int64()), "ids": pa.array([out.n_ids], pa.int64())})

    rows = ranged.mapInArrow(files, "k int, file string, documents long, ids long").collect()
    return [{"file": r.file, "documents": r.documents, "ids": r.ids} for r in sorted(rows)]


def read(spark: SparkSession, path: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and with_ids also ids (array<int>)."""
    ship(spark)
    rows, start = [], 0
    for m in manifest:
        rows.append((m["file"], start))
        start += m["ids"]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not rows:
        return spark.createDataFrame([], kind)

    def out(batches):
        frugal()
        fs, top = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as f:
                    cols = [[], [], [], [], []]
                    for d, pieces in Reader(f).documents():
                        crc = n = 0
                        for x in pieces:
                            crc = zlib.crc32(x, crc)
                            n += len(x)
                        for c, v in zip(cols, (d, at, n, crc, np.concatenate(pieces).astype(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                        at += n
                        if len(cols[0]) == 4096:
                            yield batch(cols)
                            cols = [[], [], [], [], []]
                    if cols[0]:
                        yield batch(cols)

    def batch(cols):
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int32()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return spark.createDataFrame(rows, "file string, start long").repartition(len(rows)).mapInArrow(out, kind)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, planes: str = "byte") -> DataFrame:
    """Writes the documents to plane files and reads them back."""
    path = path or scratch(docs.sparkSession, "planes")
    return read(docs.sparkSession, path, write(docs, path, tokenizer, planes=planes))
