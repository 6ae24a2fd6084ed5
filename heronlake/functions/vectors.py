"""Vector distances, quantization and product quantization.

Lower is nearer: cosine is 1 - cos (1 where a norm is 0), dot is the product's negative, l2 the squared distance.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmptyIndexTraining, InvalidArgument

METRICS = ("cosine", "dot", "l2")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise InvalidArgument(f"a metric is one of {', '.join(METRICS)}")
    return metric


def literal(v) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def distance(at: Column, query, metric: str) -> Column:
    """Distance of a vector column from one vector; null where the dimension differs or the vector is missing."""
    q, n = literal(query), len(query)
    if metric == "dot":
        out = -dot(at, q)
    elif metric == "l2":
        out = F.aggregate(F.zip_with(at, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    else:
        own, norm = F.sqrt(dot(at, at)), math.sqrt(sum(float(x) ** 2 for x in query))
        out = F.when((own == 0) | F.lit(norm == 0), F.lit(1.0)).otherwise(1 - dot(at, q) / (own * F.lit(norm or 1.0)))
    return F.when(F.size(at) == n, out)


def distances(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(rows x queries) of distances in double precision."""
    a, q = block.astype(np.float64), queries.astype(np.float64)
    if metric == "dot":
        return -(a @ q.T)
    if metric == "l2":
        return np.maximum((a * a).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (a @ q.T), 0)
    na, nq = np.sqrt((a * a).sum(1)), np.sqrt((q * q).sum(1))
    norm = na[:, None] * nq[None, :]
    return np.where(norm == 0, 1.0, 1 - (a @ q.T) / np.where(norm == 0, 1, norm))


def binary_code(at: Column) -> Column:
    """Signs (not under 0) of a vector as 64-bit words."""
    bits = F.transform(at, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    words = F.sequence(F.lit(0), F.floor((F.size(at) - 1) / 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, (w * 64 + 1).cast("int"), F.lit(64)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def scalar_code(at: Column) -> Column:
    """struct(low, step, code): each component as 0 to 255 between the vector's own least and greatest."""
    low, high = F.array_min(at).cast("double"), F.array_max(at).cast("double")
    step = (high - low) / 255
    return F.struct(low.alias("low"), step.alias("step"), F.transform(at, lambda x: F.when(step == 0, 0).otherwise(F.round((x - low) / step)).cast("smallint")).alias("code"))


def scalar_decode(code: Column) -> Column:
    return F.transform(code["code"], lambda c: code["low"] + code["step"] * c)


def lloyd(x: np.ndarray, k: int, rounds: int = 16) -> np.ndarray:
    """k centroids, begun at evenly spaced rows; an empty cluster keeps its centroid."""
    c = x[(np.arange(k) * len(x)) // k].astype(np.float64)
    for _ in range(rounds):
        at = distances(x, c, "l2").argmin(axis=1)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    return c


class Pq:
    """m subspaces of k centroids each."""

    def __init__(self, books: np.ndarray):
        self.books = books  # m x k x dim/m
        self.m, self.k, self.sub = books.shape

    @property
    def dim(self) -> int:
        return self.m * self.sub

    @staticmethod
    def train(x: np.ndarray, m: int, k: int) -> Pq:
        if not 2 <= k <= 256 or m < 1:
            raise InvalidArgument("PQ: k is from 2 to 256 and m is 1 at least")
        if x.ndim != 2 or not len(x) or x.shape[1] % m:
            raise EmptyIndexTraining("PQ needs vectors whose dimension m divides")
        parts = x.astype(np.float64).reshape(len(x), m, -1)
        return Pq(np.stack([lloyd(parts[:, j], k) for j in range(m)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.asarray(x, np.float64).reshape(-1, self.m, self.sub)
        return np.stack([distances(parts[:, j], self.books[j], "l2").argmin(axis=1) for j in range(self.m)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][codes[:, j]] for j in range(self.m)], axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """(m x k) squared distances of a query's parts from the centroids."""
        parts = np.asarray(query, np.float64).reshape(self.m, self.sub)
        return np.stack([distances(self.books[j], parts[j : j + 1], "l2")[:, 0] for j in range(self.m)])

    def adc(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        return sum(table[j][codes[:, j]] for j in range(self.m))

    def distance(self, codes: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
        return self.adc(codes, self.table(query)) if metric == "l2" else distances(self.decode(codes), np.asarray(query)[None, :], metric)[:, 0]

    def to_bytes(self) -> bytes:
        return np.array(self.books.shape, "<u4").tobytes() + self.books.astype("<f8").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Pq:
        shape = np.frombuffer(data, "<u4", 3)
        return Pq(np.frombuffer(data, "<f8", offset=12).reshape(shape).copy())
