"""What the operators of this subpackage share: intermediate tables, and text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ship, shared_dir  # noqa: F401

SPACES = "[\\x20\\x09-\\x0D]+"
#: ASCII characters that may stand in a word of the kind [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case; bytes of 0x80 and more stay.
WORD_BYTES = np.array([c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256)], np.uint8)
#: Words of the kind [^\x20\x09-\x0D]+, A-Z in lower case.
SPACE_BYTES = np.array([32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths made since each ``cleared`` that is open began.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/heronlake-{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """Deletes at its end what ``scratch`` named within it: for use around an action whose result is whole by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        made = _OPEN.pop()
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Partitions that the plan's first stage has, without running it."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def words(text, lower: bool = False):
    """Column: the words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(ascii_lower(trimmed) if lower else trimmed, SPACES))


def ascii_lower(text):
    """A-Z only: lower() would change other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = ~text.rlike("[^\\x00-\\x7F]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def frugal() -> None:
    """Gives freed memory back: Python workers live on from task to task, and would keep the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches, column: int = 1, most: int = 4 << 20):
    """Record batches cut to so many bytes of a text column, or one row."""
    frugal()
    for b in batches:
        _, offsets = buffers(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
        frugal()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finalizer of splitmix64); one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at once, some 24 bytes of memory for each.
STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15
#: Weight of a word's length in its hash.
LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts, and the ordinal of each text's first word (one more at the end).

    A word is a run of bytes that the table doesn't map to a space; words don't cross texts.
    The hash is a polynomial in the word's bytes modulo 2**64, from running sums, and the word's length, which tells bytes of
    0 at its end from none. No Python object is made for a word.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if n > 3 * STEP // 2:  # in steps that end between words
        found, firsts, at, k, words = [], np.empty(len(offsets), np.int64), 0, 0, 0
        while at < n:
            to = at + STEP
            while to < n:
                space = np.flatnonzero(table[raw[to : to + STEP]] == 32)
                to += int(space[0]) if len(space) else STEP
                if len(space):
                    break
            to = min(to, n)
            j = len(offsets) if to == n else int(np.searchsorted(offsets, to, "right"))
            own = np.concatenate([[0], offsets[k:j] - at, [to - at]])
            h, starts = word_hashes_of(raw[at:to], own, table)
            firsts[k:j] = starts[1:-1] + words
            found.append(h)
            at, k, words = to, j, words + len(h)
        return np.concatenate(found), firsts
    return word_hashes_of(raw, offsets, table)


def word_hashes_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    b = table[raw]
    is_word = b != 32
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start[firsts] = is_word[firsts]
    begin = np.flatnonzero(start)
    end_flag = is_word.copy()
    end_flag[:-1] &= ~is_word[1:]
    lasts = firsts[1:] - 1
    end_flag[lasts] = is_word[lasts]
    end = np.flatnonzero(end_flag) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(b * up[:n], out=total[1:])
    h = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * LENGTH)
    return h, np.searchsorted(begin, offsets).astype(np.int64)


#: Ids that are broadcast at most: 16 MB or so.
FEW_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less those whose key is in ids (a column of that name): by broadcast up to FEW_IDS, beyond that by a shuffle. Null keys stay."""
    gone = cut(ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct())
    if gone.limit(FEW_IDS + 1).count() <= FEW_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(docs.columns)
