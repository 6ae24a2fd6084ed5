"""Nearest neighbours: exact, in batches, by quantized codes and by inverted lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptyIndexTraining
from ..functions import vectors as V
from ..functions.kinds import resolve
from ..shared import ship

#: Vectors that a codebook or cells are trained on at most.
TRAINED_ON = 50_000
#: Recall that candidates are made wide enough for on the sample, so that searches keep 0.9 or more, and searches that it is measured by.
RECALL, MEASURED_BY = 0.95, 100


def exact(df: DataFrame, field: str, query, k: int, metric: str = "cosine") -> DataFrame:
    """df's k nearest rows with ``distance``, ties by key; rows without a vector of the query's dimension don't count."""
    V.check_metric(metric)
    at, _ = resolve(df, field)
    if at is None:
        return df.withColumn("distance", F.lit(None).cast("double")).limit(0)
    return df.withColumn("distance", V.distance(at, query, metric)).where("distance is not null").orderBy("distance", "key").limit(k)


def batch(df: DataFrame, field: str, queries: list[tuple], k: int, metric: str = "cosine") -> DataFrame:
    """query, rank, key, distance of each query's k nearest rows: a stated set of queries against all rows.

    Each partition multiplies its rows with the queries' matrix and keeps k for each query, so what is shuffled is
    partitions * queries * k rows at most.
    """
    V.check_metric(metric)
    ids, matrix = [q[0] for q in queries], np.array([q[1] for q in queries], np.float64)
    kind = df.schema["key"].dataType.simpleString()

    def nearest(batches):
        best_d, best_k = [[] for _ in ids], [[] for _ in ids]
        for b in batches:
            column = b.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            if not len(sizes):
                continue
            ok = np.asarray(column.is_valid()) & (sizes == matrix.shape[1])
            keys = np.array(b.column(0).to_pylist(), object)[ok]
            if not len(keys):
                continue
            flat = np.asarray(column.filter(pa.array(ok)).flatten()).reshape(len(keys), -1)
            d = V.distances(flat, matrix, metric)
            for q in range(len(ids)):
                most = np.argpartition(d[:, q], min(k, len(keys)) - 1)[:k] if len(keys) > k else np.arange(len(keys))
                edge = d[most, q].max()
                most = np.flatnonzero(d[:, q] <= edge)  # all ties of the last, so that keys decide
                rows = sorted(zip(best_d[q] + d[most, q].tolist(), best_k[q] + keys[most].tolist(), strict=True))[:k]
                best_d[q], best_k[q] = [r[0] for r in rows], [r[1] for r in rows]
        for q, i in enumerate(ids):
            if best_d[q]:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(best_d[q])), pa.array(best_k[q]), pa.array(best_d[q])], names=["query", "key", "distance"])

    at, _ = resolve(df, field)
    query_kind = "string" if isinstance(ids[0], str) else "long"
    ship(df.sparkSession)
    near = df.select("key", at.alias("v")).mapInArrow(nearest, f"query {query_kind}, key {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "distance")


def batch_near(coded: DataFrame, code, field: str, queries: list[tuple], k: int, metric: str, near, radius: np.ndarray) -> DataFrame:
    """batch() among candidates only: rows whose code is within the query's radius.

    ``near`` gives (rows x queries) distances of an Arrow array of codes. Exact distances are computed for candidates alone.
    """
    V.check_metric(metric)
    ids, matrix = [q[0] for q in queries], np.array([q[1] for q in queries], np.float64)
    kind = coded.schema["key"].dataType.simpleString()

    def nearest(batches):
        best = [[] for _ in ids]
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            ok = np.asarray(b.column(1).is_valid()) & np.asarray(b.column(2).is_valid()) & (sizes == matrix.shape[1])
            if not ok.any():
                continue
            b = b.filter(pa.array(ok))
            flat, keys = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), b.column(0).to_pylist()
            within = near(b.column(2)) <= radius
            for q in range(len(ids)):
                rows = np.flatnonzero(within[:, q])
                if not len(rows):
                    continue
                d = V.distances(flat[rows], matrix[q : q + 1], metric)[:, 0]
                few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else range(len(d))  # with ties of the last
                best[q] = sorted(best[q] + [(d[i], keys[rows[i]]) for i in few])[:k]
        for i, found in zip(ids, best, strict=True):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found)), pa.array([x[1] for x in found]), pa.array([float(x[0]) for x in found])], names=["query", "key", "distance"])

    at, _ = resolve(coded, field)
    query_kind = "string" if isinstance(ids[0], str) else "long"
    ship(coded.sparkSession)
    found = coded.select("key", at.alias("v"), code.alias("code")).mapInArrow(nearest, f"query {query_kind}, key {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "distance")


def share(x: np.ndarray, near, k: int, metric: str) -> float:
    """The share of rows, nearest codes first, that holds RECALL of the k nearest neighbours in the sample x.

    ``near``: (rows x queries) distances of x's codes from given vectors. Queries are rows of x, which don't count as their
    own neighbours. Of more rows than the sample the k nearest are nearer, so the share suffices there too.
    """
    n = len(x)
    if n <= k + 1:
        return 1.0
    at = np.unique((np.arange(MEASURED_BY) * n) // MEASURED_BY)
    true, code = V.distances(x, x[at], metric), near(x[at])
    true[at, np.arange(len(at))] = np.inf
    ranks = []
    for q in range(len(at)):
        top = np.argpartition(true[:, q], k - 1)[:k]
        ranks.append(np.searchsorted(np.sort(code[:, q]), code[top, q], side="right"))
    return max(float(np.quantile(np.concatenate(ranks), RECALL, method="higher")), k) / n


def radii(near, matrix: np.ndarray, part: float) -> np.ndarray:
    """Each query's code distance within which that part of the sample's rows lies, for some queries at a time."""
    found = [np.quantile(near(matrix[i : i + 32]), part, axis=0, method="higher") for i in range(0, len(matrix), 32)]
    return np.concatenate(found) + 1e-9


def _code(at, how: str):
    return V.binary_code(at) if how == "binary" else V.scalar_decode(V.scalar_code(at))


def _coded(x: np.ndarray, how: str) -> np.ndarray:
    """_code() of a block of vectors: signs or decoded components."""
    if how == "binary":
        return np.where(x >= 0, 1.0, -1.0)
    low = x.min(1, keepdims=True)
    step = (x.max(1, keepdims=True) - low) / 255
    return low + step * np.round((x - low) / np.where(step == 0, 1, step))


def _near_codes(x: np.ndarray, to: np.ndarray, how: str, metric: str) -> np.ndarray:
    """Distances of codes, of _coded(), from queries. Signs differ in a quarter of their squared distance."""
    return V.distances(x, np.where(to >= 0, 1.0, -1.0), "l2") / 4 if how == "binary" else V.distances(x, to, metric)


def batch_by_codes(df: DataFrame, field: str, queries: list[tuple], k: int, metric: str = "cosine", how: str = "binary") -> DataFrame:
    """batch() among candidates by binary or scalar codes, as many as recall needs."""
    matrix = np.array([q[1] for q in queries], np.float64)
    dim = matrix.shape[1]
    at, _ = resolve(df, field)
    same = df.where(F.size(at) == dim)
    x, radius = sample(same, field), np.full(len(queries), -1.0)
    if len(x):
        own = _coded(x, how)
        of = lambda to: _near_codes(own, to, how, metric)
        radius = radii(of, matrix, share(x, of, k, metric))

    def near(codes):
        block = np.asarray(codes.flatten()).reshape(len(codes), -1)
        if how == "binary":
            block = np.unpackbits(np.ascontiguousarray(block).view(np.uint8), axis=1, bitorder="little")[:, :dim] * 2.0 - 1
        return _near_codes(block, matrix, how, metric)

    return batch_near(same, _code(at, how), field, queries, k, metric, near, radius)


def by_codes(df: DataFrame, field: str, query, k: int, metric: str = "cosine", how: str = "binary", over: int | None = None) -> DataFrame:
    """Candidates by binary or scalar codes (over * k of them, or as many as recall needs), ranked again by exact distance."""
    at, _ = resolve(df, field)
    same = df.where(F.size(at) == len(query))
    if how == "binary":
        near = V.hamming(V.binary_code(at), V.binary_code(V.literal(query)))
    else:
        near = V.distance(V.scalar_decode(V.scalar_code(at)), query, metric)
    if over is None:
        x = sample(same, field)
        most = math.ceil(share(x, lambda to, own=_coded(x, how): _near_codes(own, to, how, metric), k, metric) * same.count()) if len(x) else 0
    else:
        most = over * k
    few = same.withColumn("_near", near).orderBy("_near", "key").limit(max(most, 64)).drop("_near")
    return exact(few, field, query, k, metric)


def sample(df: DataFrame, field: str, most: int = TRAINED_ON) -> np.ndarray:
    """Up to ``most`` vectors, spread by the key's hash; the documented bound of what is trained on."""
    at, _ = resolve(df, field)
    if at is None:
        return np.zeros((0, 0))
    rows = df.where(at.isNotNull()).select("key", at.alias("v")).orderBy(F.xxhash64("key"), "key").limit(most).orderBy("key").select("v").toArrow()["v"].combine_chunks()
    if not len(rows):
        return np.zeros((0, 0))
    sizes = np.diff(rows.offsets.to_numpy())
    same = rows.filter(pa.array(sizes == sizes[0]))
    return same.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(same), -1)


def train_pq(df: DataFrame, field: str, m: int, k: int) -> V.Pq:
    x = sample(df, field)
    if not len(x):
        raise EmptyIndexTraining("there is no vector to train on")
    return V.Pq.train(x, m, k)


def with_pq(df: DataFrame, field: str, pq: V.Pq) -> DataFrame:
    """df with ``code`` (binary): every row is encoded."""
    at, _ = resolve(df, field)
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def encode(column):
        import pandas as pd

        ok = column.map(lambda v: v is not None and len(v) == pq.dim)
        out = pd.Series([None] * len(column), index=column.index, dtype=object)
        if ok.any():
            out[ok] = [c.tobytes() for c in pq.encode(np.stack(column[ok].to_list()))]
        return out

    return df.withColumn("code", encode(at))


def _pq_near(pq: V.Pq, x: np.ndarray, metric: str):
    decoded = pq.decode(pq.encode(x))
    return lambda to: V.distances(decoded, to, metric)


def batch_by_pq(coded: DataFrame, field: str, pq: V.Pq, queries: list[tuple], k: int, metric: str = "l2") -> DataFrame:
    """batch() among candidates by distance of codes, as many as recall needs."""
    x, matrix = sample(coded, field), np.array([q[1] for q in queries], np.float64)
    own = _pq_near(pq, x, metric)
    radius = radii(own, matrix, share(x, own, k, metric))

    def near(codes):
        return V.distances(pq.decode(np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, pq.m)), matrix, metric)

    return batch_near(coded, F.col("code"), field, queries, k, metric, near, radius)


def by_pq(coded: DataFrame, field: str, pq: V.Pq, query, k: int, metric: str = "l2", over: int | None = None) -> DataFrame:
    """Candidates by distance of codes (asymmetric, from the query's table; over * k, or as many as recall needs), ranked again by exact distance."""

    ship(coded.sparkSession)

    @F.pandas_udf("double")
    def near(codes):
        import pandas as pd

        return pd.Series(pq.distance(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, pq.m), np.asarray(query, float), metric))

    held = coded.where("code is not null")
    if over is None:
        x = sample(held, field)
        most = math.ceil(share(x, _pq_near(pq, x, metric), k, metric) * held.count()) if len(x) else 0
    else:
        most = over * k
    few = held.withColumn("_near", near("code")).orderBy("_near", "key").limit(max(most, 64)).drop("_near", "code")
    return exact(few, field, query, k, metric)


class InvertedLists:
    """Cells around k-means centres: a search reads the nearest cells' rows and ranks them by exact distance.

    probes: (k, cells) pairs, how many cells hold RECALL of the k nearest rows of the sample; a search for more rows, or without them, reads all.
    """

    def __init__(self, centres: np.ndarray, metric: str, probes=()):
        self.centres, self.metric, self.probes = centres, metric, [(int(k), int(n)) for k, n in probes]

    @staticmethod
    def train(df: DataFrame, field: str, metric: str = "cosine", cells: int | None = None) -> InvertedLists:
        x = sample(df, field)
        if not len(x):
            raise EmptyIndexTraining("there is no vector to train on")
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        lists = InvertedLists(V.lloyd(x, min(len(x), cells or max(1, int(len(x) ** 0.5)))), metric)
        cell = V.distances(x, lists.centres, metric if metric == "cosine" else "l2").argmin(axis=1)
        for k in (10, 100, 1000):
            if len(x) > k + 1:
                lists.probes.append((k, lists._cells_for(x, cell, k)))
        return lists

    def _ranks(self, to: np.ndarray) -> np.ndarray:
        """(cells x queries): the place of each cell in the order in which a query reads them."""
        return np.argsort(np.argsort(V.distances(self.centres, np.asarray(to, float), self.metric), axis=0, kind="stable"), axis=0)

    def _cells_for(self, x: np.ndarray, cell: np.ndarray, k: int) -> int:
        at = np.unique((np.arange(MEASURED_BY) * len(x)) // MEASURED_BY)
        true, ranks = V.distances(x, x[at], self.metric), self._ranks(x[at])
        true[at, np.arange(len(at))] = np.inf
        found = [ranks[cell[np.argpartition(true[:, q], k - 1)[:k]], q] for q in range(len(at))]
        return 1 + int(np.quantile(np.concatenate(found), RECALL, method="higher"))

    def cells_for(self, k: int) -> int:
        return next((n for most, n in self.probes if k <= most), len(self.centres))

    def assign(self, df: DataFrame, field: str) -> DataFrame:
        """df with ``cell``, by which its files can be laid out."""
        ship(df.sparkSession)
        at, _ = resolve(df, field)
        centres, metric = self.centres, self.metric

        @F.pandas_udf("int")
        def cell(column):
            import pandas as pd

            ok = column.map(lambda v: v is not None and len(v) == centres.shape[1])
            out = pd.Series([None] * len(column), index=column.index, dtype="Int32")
            if ok.any():
                out[ok] = V.distances(np.stack(column[ok].to_list()), centres, metric if metric == "cosine" else "l2").argmin(axis=1)
            return out

        return df.withColumn("cell", cell(at))

    def probe(self, query, cells: int) -> list[int]:
        d = V.distances(self.centres, np.asarray(query, float)[None, :], self.metric)[:, 0]
        return [int(c) for c in np.argsort(d, kind="stable")[:cells]]

    def search(self, assigned: DataFrame, field: str, query, k: int, cells: int | None = None) -> DataFrame:
        return exact(assigned.where(F.col("cell").isin(self.probe(query, cells or self.cells_for(k)))).drop("cell"), field, query, k, self.metric)

    def search_batch(self, assigned: DataFrame, field: str, queries: list[tuple], k: int) -> DataFrame:
        """batch() among the rows of each query's nearest cells."""
        ranks = self._ranks(np.array([q[1] for q in queries], np.float64))
        return batch_near(assigned, F.col("cell"), field, queries, k, self.metric, lambda cell: ranks[np.asarray(cell)], np.full(len(queries), self.cells_for(k) - 1))


class SemanticCache:
    """Answers under embeddings: a look-up gives the nearest one's value if it is near enough."""

    def __init__(self, df: DataFrame, metric: str = "cosine", threshold: float = 0.1):
        self.df, self.metric, self.threshold = df, metric, threshold  # key, embedding, value

    def put(self, key: str, embedding, value: str) -> SemanticCache:
        row = self.df.sparkSession.createDataFrame([(key, list(map(float, embedding)), value)], self.df.schema)
        return SemanticCache(self.df.where(F.col("key") != key).unionByName(row), self.metric, self.threshold)

    def get(self, embedding):
        best = exact(self.df, "embedding", embedding, 1, self.metric).first()
        return best.value if best and best.distance <= self.threshold else None

    def get_batch(self, queries: list[tuple]) -> DataFrame:
        """query, key, distance of the queries that hit."""
        return batch(self.df, "embedding", queries, 1, self.metric).where(F.col("distance") <= self.threshold).select("query", "key", "distance")
