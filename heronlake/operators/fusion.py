"""Rank fusion and diversity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import check_metric, distances

RRF_K = 60.0


def ranked(df: DataFrame, *order) -> DataFrame:
    """key, rank (from 1) of an ordered list of k rows at most, which makes its one window small."""
    return df.withColumn("_one", F.lit(1)).select("key", F.row_number().over(Window.partitionBy("_one").orderBy(*order, "key")).alias("rank"))


def rrf(lists: list[DataFrame], k: float = RRF_K) -> DataFrame:
    """key, score: sums of 1 / (k + rank); each list counts a key once, by its best rank."""
    if not (math.isfinite(k) and k > 0):
        raise InvalidArgument("fusion needs a finite k over 0")
    every = None
    for one in lists:
        once = one.groupBy("key").agg(F.min("rank").alias("rank"))
        every = once if every is None else every.unionByName(once)
    return every.groupBy("key").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def mmr(query, keys: list, vectors: list, weight: float, metric: str = "cosine") -> list:
    """Keys in the order of greedy maximal marginal relevance: weight * nearness to the query - (1 - weight) * greatest nearness to what is chosen. Ties by key."""
    check_metric(metric)
    if not 0 <= weight <= 1:
        raise InvalidArgument("the weight of MMR is from 0 to 1")
    if not keys:
        return []
    x = np.array(vectors, np.float64)
    near = -distances(x, np.array([query], np.float64), metric)[:, 0]
    penalty, left, out = np.full(len(keys), -np.inf), sorted(range(len(keys)), key=lambda i: keys[i]), []
    while left:
        score = lambda i: weight * near[i] - (1 - weight) * (penalty[i] if out else 0.0)
        best = max(left, key=score)  # the first of equals, which has the smallest key
        out.append(keys[best])
        left.remove(best)
        penalty = np.maximum(penalty, -distances(x, x[best : best + 1], metric)[:, 0])
    return out
