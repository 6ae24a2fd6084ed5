"""Recall of the indexes at their defaults, over all ids that 100 divides as queries, on vectors without clusters."""

from __future__ import annotations

import numpy as np
import pytest

from heronlake.operators import vector
from heronlake import queries as Q

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(8).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>").repartition(3).cache()
    asked = [(i, x[i].tolist()) for i in range(0, 3000, 100)]
    return df, asked, {(r.query, r.key) for r in vector.batch(df, "v", asked, 10, "l2").collect()}


def recall(found, want, asked):
    got = {(r.query, r.key) for r in found.collect()}
    assert len(got) == 10 * len(asked)
    return len(got & want) / len(want)


def test_batches_hold_recall(cloud):
    df, asked, want = cloud
    for how in ("binary", "scalar"):
        assert recall(vector.batch_by_codes(df, "v", asked, 10, "l2", how), want, asked) >= 0.9
    pq = vector.train_pq(df, "v", 8, 32)
    assert recall(vector.batch_by_pq(vector.with_pq(df, "v", pq), "v", pq, asked, 10, "l2"), want, asked) >= 0.9
    lists = vector.InvertedLists.train(df, "v", "l2")
    assert recall(lists.search_batch(lists.assign(df, "v"), "v", asked, 10), want, asked) >= 0.9


def test_single_searches_hold_recall_at_defaults(cloud):
    df, asked, want = cloud
    few = asked[:12]
    lists, pq = vector.InvertedLists.train(df, "v", "l2"), vector.train_pq(df, "v", 8, 32)
    assigned, coded = lists.assign(df, "v").cache(), vector.with_pq(df, "v", pq).cache()
    for search in (
        lambda q: lists.search(assigned, "v", q, 10),
        lambda q: vector.by_codes(df, "v", q, 10, "l2", "binary"),
        lambda q: vector.by_pq(coded, "v", pq, q, 10),
    ):
        hits = sum((i, r.key) in want for i, q in few for r in search(q).select("key").collect())
        assert hits >= 9 * len(few)


def test_index_queries_ask_all_ids_and_can_fail(spark, monkeypatch):
    df = Q._vectors(spark, SF)
    asked = {q for q, _ in Q._asked(df)}
    assert asked == set(range(0, df.count(), 100))
    for name in ("knn_binary", "knn_scalar", "knn_pq", "knn_cells"):
        rows = [tuple(r) for r in Q.QUERIES[name](spark, SF).select("query", "nearest", "n_found", "enough").collect()]
        assert sorted(rows) == [(q, q, 10, True) for q in sorted(asked)], name

    def few(df, field, queries, *a, **b):  # each query's own row, and nothing else
        return df.sparkSession.createDataFrame([(q, q, 1) for q, _ in queries], "query long, key long, rank int")

    monkeypatch.setattr(vector, "batch_by_codes", few)
    assert {(r.n_found, r.enough) for r in Q.QUERIES["knn_binary"](spark, SF).collect()} == {(1, False)}
