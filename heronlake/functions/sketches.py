"""Sketches: Spark's own where it has them, small numpy objects that merge by partition where it hasn't."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..shared import ship
from .kinds import let


def approx_distinct(x: Column, precision: int = 14) -> Column:
    """HyperLogLog estimate of the distinct values, as an aggregate."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(x, F.lit(max(4, min(16, precision)))))


def hash_pair(column: Column) -> list[Column]:
    return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]


class BloomFilter:
    """n values at a false-positive rate; rows are hashed in Spark, bits are set in numpy and merged by OR."""

    def __init__(self, n: int, rate: float = 0.01):
        if n < 1 or not 0 < rate < 1:
            raise InvalidArgument("a Bloom filter needs n of 1 at least and a rate between 0 and 1")
        self.bits = max(64, -(-int(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)
        self.k = max(1, round(self.bits / n * math.log(2)))
        self.words = np.zeros(self.bits // 8, np.uint8)

    def _at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        b = b | np.uint64(1)
        return ((a[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(self.bits)).astype(np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        at = self._at(a, b).ravel()
        np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._at(a, b)
        return ((self.words[at >> 3] >> (at & 7)) & 1).all(axis=1)

    @staticmethod
    def build(df: DataFrame, column: str, n: int, rate: float = 0.01) -> BloomFilter:
        """Filters of partitions are merged on the driver in pieces, as they come: one filter's size for each partition."""
        out = BloomFilter(n, rate)

        def bits(batches):
            mine = BloomFilter(n, rate)
            for x in batches:
                mine.add(*[np.asarray(c).view(np.uint64) for c in x.columns])
            yield pa.RecordBatch.from_pydict({"words": pa.array([mine.words.tobytes()], pa.binary())})

        hashed = df.where(F.col(column).isNotNull()).select(*hash_pair(F.col(column)))
        ship(df.sparkSession)
        for r in hashed.mapInArrow(bits, "words binary").toLocalIterator():
            out.words |= np.frombuffer(r.words, np.uint8)
        return out

    def test(self, df: DataFrame, column: str, to: str = "maybe") -> DataFrame:
        """df with a boolean column: false means certainly not among the added values."""
        mine = self

        ship(df.sparkSession)

        @F.pandas_udf("boolean")
        def has(a, b):
            import pandas as pd

            return pd.Series(mine.has(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)))

        return df.withColumn(to, F.when(F.col(column).isNotNull(), has(*hash_pair(F.col(column)))).otherwise(False))


def digest64(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little")


class CuckooFilter:
    """Fingerprints in buckets of four, each at one of two places; values can be deleted. Fails rather than lose a fingerprint."""

    SLOTS, KICKS = 4, 500

    def __init__(self, n: int):
        self.size = 1 << max(1, (max(1, n) // 3).bit_length())
        self.table = np.zeros((self.size, self.SLOTS), np.uint16)

    def _places(self, value: bytes) -> tuple[int, int, int]:
        h = digest64(value)
        mark = (h >> 48) or 1
        one = h & (self.size - 1)
        return mark, one, self._other(one, mark)

    def _other(self, at: int, mark: int) -> int:
        return at ^ (digest64(mark.to_bytes(2, "little")) & (self.size - 1))

    def _put(self, at: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = mark
        return bool(len(free))

    def add(self, value: bytes) -> bool:
        mark, one, two = self._places(value)
        if self._put(one, mark) or self._put(two, mark):
            return True
        before, at = [], one
        for k in range(self.KICKS):
            slot = k % self.SLOTS
            before.append((at, slot, int(self.table[at, slot])))
            self.table[at, slot], mark = mark, int(self.table[at, slot])
            at = self._other(at, mark)
            if self._put(at, mark):
                return True
        for at, slot, old in reversed(before):
            self.table[at, slot] = old
        return False

    def has(self, value: bytes) -> bool:
        mark, one, two = self._places(value)
        return bool((self.table[one] == mark).any() or (self.table[two] == mark).any())

    def delete(self, value: bytes) -> bool:
        mark, one, two = self._places(value)
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False


class TDigest:
    """Centroids that are fine at the ends; merges."""

    def __init__(self, delta: float = 100.0):
        self.delta, self.means, self.weights = max(1.0, delta), np.zeros(0), np.zeros(0)
        self.low, self.high, self.open = math.inf, -math.inf, []

    def add(self, x: float, weight: float = 1.0) -> None:
        if math.isfinite(x):
            self.low, self.high = min(self.low, x), max(self.high, x)
            self.open.append((x, weight))
            if len(self.open) >= 10 * self.delta:
                self._squeeze()

    def extend(self, values: np.ndarray) -> None:
        """Many values at once: sorted, and summed within steps of the scale, which is what _squeeze keeps apart at best."""
        x = np.sort(values[np.isfinite(values)].astype(np.float64))
        if not len(x):
            return
        self.low, self.high = min(self.low, float(x[0])), max(self.high, float(x[-1]))
        q = (np.arange(len(x)) + 0.5) / len(x)
        step = np.floor(self.delta / math.pi * np.arcsin(2 * q - 1)).astype(np.int64)
        starts = np.flatnonzero(np.diff(step, prepend=step[0] - 1))
        weights = np.diff(np.append(starts, len(x)))
        self.open += list(zip((np.add.reduceat(x, starts) / weights).tolist(), weights.astype(float).tolist(), strict=True))
        self._squeeze()

    @staticmethod
    def build(df: DataFrame, column: str, delta: float = 100.0) -> TDigest:
        """Of a frame's column (nulls and NaN don't count). Each partition makes a digest; they are merged on the driver as they come, some hundred centroids each."""
        out = TDigest(delta)

        def digest(batches):
            mine = TDigest(delta)
            for b in batches:
                mine.extend(b.column(0).to_numpy(zero_copy_only=False))
            mine._squeeze()
            row = {"means": [mine.means.tolist()], "weights": [mine.weights.tolist()], "low": [mine.low], "high": [mine.high]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64())), ("low", pa.float64()), ("high", pa.float64())]))

        ship(df.sparkSession)
        values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double"))
        for r in values.mapInArrow(digest, "means array<double>, weights array<double>, low double, high double").toLocalIterator():
            part = TDigest(delta)
            part.means, part.weights, part.low, part.high = np.array(r.means), np.array(r.weights), r.low, r.high
            out.merge(part)
        return out

    def merge(self, other: TDigest) -> None:
        other._squeeze()
        self.open += list(zip(other.means.tolist(), other.weights.tolist(), strict=True))
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._squeeze()

    def _squeeze(self) -> None:
        if not self.open:
            return
        x, w = (np.array(v) for v in zip(*self.open, strict=True))
        means, weights = np.concatenate([self.means, x]), np.concatenate([self.weights, w])
        order = np.argsort(means, kind="stable")
        means, weights, self.open = means[order], weights[order], []
        total, out, done = weights.sum(), [], 0.0
        for m, w in zip(means.tolist(), weights.tolist(), strict=True):
            if out:
                q0, q1 = done / total, (done + out[-1][1] + w) / total
                if self._scale(q1) - self._scale(q0) <= 1:
                    out[-1][0] += (m - out[-1][0]) * w / (out[-1][1] + w)
                    out[-1][1] += w
                    continue
                done += out[-1][1]
            out.append([m, w])
        self.means, self.weights = (np.array(v) for v in zip(*out, strict=True))

    def _scale(self, q: float) -> float:
        return self.delta / (2 * math.pi) * math.asin(2 * min(max(q, 0.0), 1.0) - 1)

    def quantile(self, q: float) -> float | None:
        self._squeeze()
        if not len(self.means):
            return None
        if q <= 0 or q >= 1:
            return self.low if q <= 0 else self.high
        middle = np.cumsum(self.weights) - self.weights / 2
        return float(np.interp(q * self.weights.sum(), [0, *middle, self.weights.sum()], [self.low, *self.means, self.high]))

    def cdf(self, x: float) -> float | None:
        self._squeeze()
        if not len(self.means):
            return None
        if x <= self.low or x >= self.high:
            return 0.0 if x < self.low else 1.0 if x >= self.high else float(self.weights[self.means == self.low].sum() / self.weights.sum())
        middle = np.cumsum(self.weights) - self.weights / 2
        return float(np.interp(x, [self.low, *self.means, self.high], [0, *middle, self.weights.sum()]) / self.weights.sum())


def minhash(items: Column, k: int = 128) -> Column:
    """k least hashes of a set of items, each under a seed of its own; null of an empty set. An item is hashed once, its hash k times."""
    least = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))
    return F.when(F.size(items) > 0, let(F.transform(items, lambda x: F.xxhash64(x)), least))


def jaccard_estimate(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def lsh_bands(signature: Column, bands: int, rows: int) -> Column:
    """Array of one hash for each band of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, F.lit(rows))))


def lsh_candidates(df: DataFrame, key: str, signature: str, bands: int, rows: int, probes: DataFrame | None = None) -> DataFrame:
    """probe, key: rows of df that share a band with a probe (key and signature columns of probes, or df itself), in no order."""
    probes = df if probes is None else probes
    side = lambda d, n: d.select(F.col(key).alias(n), F.explode(lsh_bands(F.col(signature), bands, rows)).alias("band"))
    found = side(probes, "probe").join(side(df, "key"), "band").where("probe <> key").select("probe", "key")
    return found.distinct()
