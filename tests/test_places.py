"""Global places, breadth-first levels in both ways of placing them, and digests of frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.functions.sketches import TDigest
from heronlake.operators import graph
from heronlake.operators.order import placed


def test_places_of_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("key"), (F.col("id") % 3).alias("x"))
    got = {r.place: (r.x, r.key) for r in placed(rows.orderBy("x", "key")).collect()}
    want = sorted((r.x, r.key) for r in rows.collect())
    assert got == {i: w for i, w in enumerate(want, 1)}
    assert placed(rows.where("false").orderBy("key")).count() == 0


@pytest.mark.parametrize("few", [100_000, 0])
def test_levels(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    pairs = [("m", "z"), ("m", "t"), ("m", "p"), ("p", "w"), ("t", "k"), ("z", "j"), ("w", "m"), ("k", "j")]
    edges = spark.createDataFrame([("to", a, b, 1.0) for a, b in pairs] + [("other", "m", "q", 1.0)], graph.EDGES)
    want = [("p", 1, 1), ("t", 1, 2), ("z", 1, 3), ("w", 2, 1), ("k", 2, 2), ("j", 2, 3)]
    assert [tuple(r) for r in graph.traverse(edges, "m", "to", 9).collect()] == want
    assert graph.traverse(edges, "nobody", "to", 3).count() == 0


def test_digest_of_a_frame(spark):
    x = np.random.default_rng(5).lognormal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(5)
    digest = TDigest.build(df, "x")
    for q in (0.001, 0.01, 0.25, 0.5, 0.9, 0.999):
        assert abs((x <= digest.quantile(q)).mean() - q) <= 0.01
    assert digest.quantile(0) == x.min() and digest.quantile(1) == x.max() and len(digest.means) < 300
    assert TDigest.build(df.where("x is null"), "x").quantile(0.5) is None
