"""The engine on small hand-made corpora."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.errors import BackupTargetExists, EmptyIndexTraining, InvalidArgument, InvalidName, ReservedCollection, SchemaViolation
from heronlake.functions import geo as geofun
from heronlake.functions import sketches, vectors
from heronlake.functions.text import Analyzer, stem, tokenize
from heronlake.operators import fusion, geo, graph, text, vector
from heronlake.plans.predicates import field, from_json
from heronlake.plans.query import PlanCache, Query
from heronlake.sources.documents import Vector, frame
from heronlake.sources.schema import FieldRule
from heronlake.sources.store import Database
from heronlake.sources.wire import Tools


def keys(df):
    return [r.key for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("s1", {"kind": "doc", "tag": "s", "n": 1, "x": 1.5, "body": "heron nesting reeds", "v": Vector([0.8, 0.6])}),
        ("s2", {"kind": "doc", "tag": "w", "n": 2, "x": 2.5, "body": "otter river burrows", "v": Vector([-0.6, 0.8])}),
        ("s3", {"kind": "doc", "tag": "s", "n": 3, "x": 4.0, "body": "heron again reeds", "v": Vector([0.6, 0.8])}),
        ("m1", {"kind": "meta", "n": 0.5}),
        ("m2", {"kind": "meta", "n": 6}),
        ("nb", {}),
    ]
    return frame(spark, rows).cache()


def n(docs, p):
    return docs.where(p.condition(docs)).count()


def test_predicates(docs):
    f = field("n")
    assert n(docs, f.eq(1)) == 1 and n(docs, f.eq(0.5)) == 1 and n(docs, f.eq(1.0)) == 1 and n(docs, ~f.eq(1)) == 5 and n(docs, f.ne(1)) == 4
    assert n(docs, field("kind").exists()) == 5 and n(docs, field("missing").exists()) == 0 and n(docs, ~field("missing").eq(1)) == 6
    assert n(docs, f.between(0.5, 2)) == 3 and n(docs, f.between(2, 1)) == 0
    assert n(docs, field("body").starts_with("heron")) == 2 and n(docs, field("body").contains("reeds")) == 2 and n(docs, field("body").starts_with("")) == 3
    assert n(docs, f.ge(1) & f.le(3)) == 3 and n(docs, f.eq(1) | f.eq(6)) == 2
    assert n(docs, f.is_in([1, 6, "x"])) == 2 and n(docs, f.is_in([])) == 0
    assert n(docs, f.eq("1")) == 0 and n(docs, field("tag").lt("t")) == 2 and n(docs, field("tag").gt(1)) == 0 and n(docs, field("x").eq(math.nan)) == 0 and n(docs, field("x").ne(math.nan)) == 3


def test_de_morgan(docs):
    a, b = field("n").gt(1), field("tag").eq("s")
    for left, right in ((~(a & b), ~a | ~b), (~(a | b), ~a & ~b)):
        assert keys(docs.where(left.condition(docs)).orderBy("key")) == keys(docs.where(right.condition(docs)).orderBy("key"))


def test_nan_and_zero(spark):
    df = spark.createDataFrame([("a", math.nan), ("b", -0.0), ("c", 1.0), ("d", None)], "key string, x double")
    assert n(df, field("x").eq(0.0)) == 1 and n(df, field("x").gt(-1)) == 2 and n(df, field("x").ne(1.0)) == 2 and n(df, field("x").lt(math.inf)) == 2
    assert keys(Query(df).order_by("x").run()) == ["b", "c", "a", "d"] and keys(Query(df).order_by("x", True).run()) == ["c", "b", "a", "d"]
    assert [tuple(r) for r in Query(df).group_count("x").collect()] == [("f:0", 1), ("f:1", 1), ("f:NaN", 1)]


def test_kind_lattice(spark):
    df = frame(spark, [("i", {"x": 7}), ("f", {"x": 7.5}), ("t", {"x": "7"}), ("b", {"x": True}), ("a", {"x": [7]}), ("m", {"x": {"k": 7}}), ("z", {"x": None}), ("none", {})])
    assert keys(df.where(field("x").eq(7).condition(df))) == ["i"] and keys(df.where(field("x").eq("7").condition(df))) == ["t"] and n(df, field("x").exists()) == 7
    assert n(df, field("x").eq(None)) == 1 and n(df, field("x").ne(7)) == 6 and n(df, field("x.k").eq(7)) == 1 and n(df, field("x").eq([7])) == 1 and n(df, field("x").ge(7)) == 2
    assert keys(Query(df).order_by("x").run()) == ["i", "f", "t", "a", "b", "m", "z", "none"] and keys(Query(df).order_by("x", True).run()) == ["t", "f", "i", "a", "b", "m", "z", "none"]


def test_group_tags(spark):
    df = frame(spark, [(str(i), {"v": v}) for i, v in enumerate([1, 1.0, "1", True, "i:1", 1])])
    assert {r.group: r["count"] for r in Query(df).group_count("v").collect()} == {"i:1": 2, "f:1": 1, "1": 1, "b:true": 1, "t:i:1": 1}
    assert Query(df).count_distinct("v").first()[0] == 5


def test_number_text(spark):
    from heronlake.functions.kinds import plain_number

    values = [1.0, 2.5, 1e10, 1.5e-7, -123456789.125, 1e300, 0.1, 100.0, -0.0, 12345678901234567.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(plain_number(F.col("x"))).collect()]
    assert [float(x) for x in got] == values and got[:4] == ["1", "2.5", "10000000000", "0.00000015"] and all("E" not in x and not x.endswith(".") for x in got) and got[8] == "0"


def test_aggregates(docs):
    q = Query(docs)
    assert q.count().first()[0] == 6 and q.sum("x").first()[0] == 8.0 and abs(q.avg("x").first()[0] - 8 / 3) < 1e-9 and q.avg("missing").first()[0] is None and q.sum("missing").first()[0] == 0.0
    assert q.min("x").first()[0] == 1.5 and q.max("x").first()[0] == 4.0 and float(q.max("n").first()[0]) == 6 and q.count_distinct("n").first()[0] == 5
    assert [tuple(r) for r in q.group_count("tag").collect()] == [("s", 2), ("w", 1)]
    assert [tuple(r) for r in q.group_sum("tag", "x").collect()] == [("s", 5.5), ("w", 2.5)] and [tuple(r) for r in q.group_avg("tag", "x").collect()] == [("s", 2.75), ("w", 2.5)]
    assert [tuple(r) for r in q.group_count("n").collect()] == [("f:0.5", 1), ("i:1", 1), ("i:2", 1), ("i:3", 1), ("i:6", 1)]
    assert q.filter(field("tag").eq("s")).sum("x").first()[0] == 5.5 and q.approx_distinct("n").first()[0] == 5


def test_hybrid(docs):
    q = Query(docs)
    both = q.vector("v", [0.8, 0.6], 2).text("body", "heron reeds", 2).limit(2)
    assert [(r.key, round(r.score, 6)) for r in both.run().collect()] == [("s1", 0.032787), ("s3", 0.032258)]
    assert keys(both.filter(field("tag").eq("s")).run()) == ["s1", "s3"]
    assert [(r.key, round(r.score, 6)) for r in q.vector("v", [0.8, 0.6], 3).run().collect()] == [("s1", 0.016393), ("s3", 0.016129), ("s2", 0.015873)]
    assert keys(q.text("body", "heron reeds", 2).run()) == ["s1", "s3"] and keys(q.vector("v", [0.8, 0.6], 3).approx().run()) == ["s1", "s3", "s2"]
    assert keys(q.vector("v", [0.8, 0.6], 3).rerank_mmr(1.0).run()) == ["s1", "s3", "s2"] and keys(q.vector("v", [0.8, 0.6], 3).rerank_mmr(0.0).run())[1] == "s2"
    assert keys(q.order_by("n").run()) == ["m1", "s1", "s2", "s3", "m2", "nb"] and keys(q.order_by("n", True).run()) == ["m2", "s3", "s2", "s1", "m1", "nb"] and keys(q.order_by("n").offset(2).limit(2).run()) == ["s2", "s3"]
    assert keys(q.limit(0).run()) == [] and keys(q.offset(99).run()) == [] and keys(q.run()) == ["m1", "m2", "nb", "s1", "s2", "s3"]
    assert q.select("tag").run().columns == ["key", "score", "tag"] and q.select().run().columns == ["key", "score"]
    for bad in (q.fuse_rrf(0), q.fuse_rrf(math.nan), q.rerank_mmr(1.5), q.limit(-1), q.vector("v", [1], 1, "other")):
        with pytest.raises(InvalidArgument):
            bad.run()
    assert "text" in q.text("body", "heron", 1).explain() and q.plan_key() != q.limit(1).plan_key()
    cache = PlanCache()
    assert cache.get_or_insert_with("a", lambda: 1) == 1 == cache.get_or_insert_with("a", lambda: 2) and len(cache) == 1


def test_phrase(docs):
    got = text.phrase(docs, "body", "nesting reeds", 10).collect()
    assert [(r.key, round(r.score, 5)) for r in got] == [("s1", 1.45083)]
    assert keys(text.phrase(docs, "body", "reeds nesting", 10)) == [] and keys(text.phrase(docs, "body", "reeds", 10)) == ["s1", "s3"] and round(text.phrase(docs, "body", "reeds", 1).first().score, 5) == 0.47
    assert keys(text.search(docs, "body", "the of", 5)) == [] and keys(text.search(docs, "n", "heron", 5)) == []


def test_analyzer(spark):
    words = {"cats": "cat", "parties": "party", "houses": "house", "boxes": "boxe", "running": "running", "was": "was", "is": "is", "press": "press", "class": "class", "bus": "bus", "genus": "genus", "always": "alway", "goes": "goe", "cafés": "cafés"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == words
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(tokenize(F.col("t"))).first()[0]
    assert one("Hello, WORLD 42! über") == ["hello", "world", "42", "über"] and one("東京タワーabc 中") == ["東京", "京タ", "タワ", "ワー", "abc", "中"]
    assert text.terms_of(spark, Analyzer(), "The cats and the cats") == ["cat", "cat"] and text.terms_of(spark, Analyzer.raw(), "The cats") == ["the", "cats"]


def test_postings_agree(spark, docs):
    index = text.postings(docs, "body")
    for q in ("heron reeds", "heron heron again"):
        terms = text.terms_of(spark, Analyzer(), q)
        a = [(r.key, round(r.score, 9)) for r in text.search(docs, "body", q, 5).collect()]
        assert a == [(r.key, round(r.score, 9)) for r in text.search_postings(index, {"n": 3, "avg": 3.0}, terms, 5).collect()]
    terms = text.terms_of(spark, Analyzer(), "heron nesting")
    assert [(r.key, round(r.score, 9)) for r in text.phrase_postings(index, {"n": 3, "avg": 3.0}, terms, 5).collect()] == [(r.key, round(r.score, 9)) for r in text.phrase(docs, "body", "heron nesting", 5).collect()]


CORPUS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [2.0, 0.0]), ("e", [1.0, 0.0]), ("f", [1.0]), ("g", None)]


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame(CORPUS, "key string, v array<float>").cache()


@pytest.mark.parametrize("metric,want", [("cosine", [("a", 0), ("d", 0), ("e", 0), ("b", 1), ("c", 2)]), ("dot", [("d", -2), ("a", -1), ("e", -1), ("b", 0), ("c", 1)]), ("l2", [("a", 0), ("e", 0), ("d", 1), ("b", 2), ("c", 4)])])
def test_metrics(vecs, metric, want):
    assert [(r.key, r.distance) for r in vector.exact(vecs, "v", [1, 0], 10, metric).collect()] == want
    got = vector.batch(vecs, "v", [("q", [1.0, 0.0])], 10, metric).orderBy("rank").collect()
    assert [(r.key, round(r.distance, 9)) for r in got] == want
    assert keys(vector.exact(vecs, "v", [0, 0], 1, "cosine")) == ["a"] and keys(vector.exact(vecs, "v", [1, 0], 0)) == []


def test_batch_ties(spark):
    df = spark.createDataFrame([(f"k{i:02d}", [1.0, 0.0]) for i in range(20)], "key string, v array<float>").repartition(3)
    assert keys(vector.batch(df, "v", [(1, [1.0, 0.0])], 3).orderBy("rank")) == ["k00", "k01", "k02"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 600)]
    return spark.createDataFrame([(f"{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "key string, v array<float>").cache(), x


def recall(df, x, search, k=10):
    hits = 0
    for i in range(0, 600, 60):
        want = set(keys(vector.exact(df, "v", x[i].tolist(), k, "l2")))
        hits += len(want & set(keys(search(x[i].tolist()))))
    return hits / (10 * k)


def test_approximate_recall(cloud):
    df, x = cloud
    lists = vector.InvertedLists.train(df, "v", "l2", 12)
    assigned = lists.assign(df, "v").cache()
    assert recall(df, x, lambda q: lists.search(assigned, "v", q, 10, 4)) >= 0.9
    pq = vector.train_pq(df, "v", 4, 16)
    coded = vector.with_pq(df, "v", pq).cache()
    assert recall(df, x, lambda q: vector.by_pq(coded, "v", pq, q, 10, "l2", 10)) >= 0.9
    assert recall(df, x, lambda q: vector.by_codes(df, "v", q, 10, "l2", "scalar")) >= 0.9
    assert recall(df, x, lambda q: vector.by_codes(df, "v", q, 10, "l2", "binary", 20)) >= 0.7
    again = vectors.Pq.from_bytes(pq.to_bytes())
    assert (again.encode(x) == pq.encode(x)).all() and np.allclose(pq.adc(pq.encode(x), pq.table(x[0])), ((pq.decode(pq.encode(x)) - x[0]) ** 2).sum(1))
    for m, k, e in ((3, 4, EmptyIndexTraining), (4, 1, InvalidArgument)):
        with pytest.raises(e):
            vectors.Pq.train(x, m, k)


def test_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0] * 30,)], "v array<float>")
    got = df.select(vectors.binary_code(F.col("v")).alias("b"), vectors.scalar_decode(vectors.scalar_code(F.col("v"))).alias("s")).first()
    bits = [1 if x >= 0 else 0 for x in [1.0, -1.0, 0.0] * 30]
    assert [(w >> i) & 1 for w in got.b for i in range(64)][:90] == bits and np.allclose(got.s, [1.0, -1.0, 0.0] * 30, atol=0.005)


def test_cache(spark):
    cache = vector.SemanticCache(spark.createDataFrame([("a", [1.0, 0.0], "x")], "key string, embedding array<float>, value string"), threshold=0.05)
    cache = cache.put("b", [0, 1], "y")
    assert cache.get([1, 0.1]) == "x" and cache.get([0.1, 1]) == "y" and cache.get([1, 1]) is None and [r.query for r in cache.get_batch([(1, [1, 0]), (2, [1, 1])]).collect()] == [1]


def test_mmr():
    assert fusion.mmr([1, 0], ["near", "mid", "far"], [[1, 0], [0.7, 0.7], [-1, 0]], 1.0) == ["near", "mid", "far"] and fusion.mmr([1, 0], [], [], 0.5) == []


@pytest.fixture(scope="module")
def places(spark):
    rows = [("berlin", 52.52, 13.40), ("potsdam", 52.40, 13.06), ("hamburg", 53.55, 9.99), ("munchen", 48.14, 11.58), ("east", 0.0, 10.0), ("west", 0.0, -10.0)]
    return frame(spark, [*[(k, {"loc": {"lat": a, "lon": b}}) for k, a, b in rows], ("nogeo", {"x": 1})])


def test_geo(spark, places):
    got = geo.radius(places, "loc", 52.52, 13.40, 600.0).collect()
    assert [r.key for r in got] == ["berlin", "potsdam", "hamburg", "munchen"] and np.allclose([r.distance_km for r in got], [0, 26.621424, 255.120591, 503.833264], atol=1e-5)
    assert keys(geo.radius(places, "loc", 0, 0, 1111.951)) == ["east", "west"] and keys(geo.radius(places, "loc", 0, 0, math.nan)) == []
    assert keys(geo.box(places, "loc", 47, 5, 55, 15)) == ["berlin", "hamburg", "munchen", "potsdam"] and keys(geo.box(places, "loc", -1, 170, 1, -5)) == ["west"]
    assert keys(geo.nearest(places, "loc", 52.52, 13.40, 2)) == ["berlin", "potsdam"] and keys(geo.nearest(places, "loc", 0, 0, 0)) == []
    for bad in ((91, 0, 90, 0), (10, 0, 5, 0)):
        with pytest.raises(InvalidArgument):
            geo.box(places, "loc", *bad)
    assert n(places, field("loc").within_km(0, 0, 1200.0)) == 2 and abs(geofun.haversine_km(51.5074, -0.1278, 48.8566, 2.3522) - 343.5565) < 1e-3
    pairs = spark.createDataFrame([("a", [0.0, 10.0]), ("b", [0.0]), ("c", None)], "key string, loc array<double>")
    assert keys(geo.nearest(pairs, "loc", 0, 0, 5)) == ["a"]
    poles = spark.createDataFrame([("p", [89.99, 0.0]), ("q", [0.0, 179.9])], "key string, loc array<double>")
    assert keys(geo.radius(poles, "loc", 89.99, 180, 10)) == ["p"] and keys(geo.radius(poles, "loc", 0, -179.9, 50)) == ["q"]


def test_graph(spark):
    e = spark.createDataFrame([("rel", "ga", "gb", 1.0), ("rel", "ga", "gc", 1.0), ("rel", "gb", "gd", 1.0), ("wrel", "ga", "gb", 2.5), ("wrel", "ga", "gd", 0.75), ("rel", "gd", "ga", None)], graph.EDGES)
    assert keys(graph.neighbors(e, "ga", "rel")) == ["gb", "gc"] and keys(graph.in_neighbors(e, "gb", "rel")) == ["ga"]
    assert [tuple(r) for r in graph.neighbors_weighted(e, "ga", "wrel").collect()] == [("gb", 2.5), ("gd", 0.75)] and graph.neighbors_weighted(e, "gd", "rel").first().weight == 1.0
    assert [keys(graph.traverse(e, "ga", "rel", h)) for h in (0, 1, 2, 10)] == [[], ["gb", "gc"], ["gb", "gc", "gd"], ["gb", "gc", "gd"]]
    order = spark.createDataFrame([("r", "s", "b", 1.0), ("r", "s", "a", 1.0), ("r", "b", "x", 1.0), ("r", "a", "z", 1.0)], graph.EDGES)
    assert keys(graph.traverse(order, "s", "r", 2)) == ["a", "b", "z", "x"]  # by the finder's place, not by key
    assert {(r.key, r.hop) for r in graph.reachable(order, "s", "r", 2).collect()} == {("a", 1), ("b", 1), ("z", 2), ("x", 2)}


def test_sketches(spark):
    df = spark.range(3000).withColumn("s", F.col("id").cast("string"))
    bloom = sketches.BloomFilter.build(df, "s", 3000, 0.01)
    seen = bloom.test(spark.range(6000).withColumn("s", F.col("id").cast("string")), "s").groupBy((F.col("id") < 3000).alias("in")).agg(F.avg(F.col("maybe").cast("int")).alias("r")).collect()
    assert {r["in"]: r.r for r in seen}[True] == 1.0 and {r["in"]: r.r for r in seen}[False] < 0.03
    assert abs(df.select(sketches.approx_distinct(F.col("s"))).first()[0] - 3000) < 100
    cuckoo = sketches.CuckooFilter(500)
    assert all(cuckoo.add(str(i).encode()) for i in range(500)) and all(cuckoo.has(str(i).encode()) for i in range(500)) and sum(cuckoo.has(str(i).encode()) for i in range(1000, 3000)) < 40
    assert cuckoo.delete(b"7") and not cuckoo.delete(b"none")
    full = sketches.CuckooFilter(1)
    added = [i for i in range(50) if full.add(str(i).encode())]
    assert len(added) < 50 and all(full.has(str(i).encode()) for i in added)
    a, b = sketches.TDigest(), sketches.TDigest()
    for i in range(5000):
        (a if i % 2 else b).add(float(i))
    a.add(math.nan)
    a.merge(b)
    assert a.quantile(0) == 0 and a.quantile(1) == 4999 and abs(a.quantile(0.5) - 2500) < 50 and abs(a.cdf(1000) - 0.2) < 0.01 and sketches.TDigest().quantile(0.5) is None
    sets = spark.createDataFrame([("a", [str(i) for i in range(100)]), ("b", [str(i) for i in range(10, 110)]), ("c", [str(i) for i in range(500, 600)]), ("d", [])], "key string, s array<string>").withColumn("sig", sketches.minhash(F.col("s"), 128))
    est = sets.alias("x").join(sets.alias("y"), F.expr("x.key = 'a' and y.key = 'b'")).select(sketches.jaccard_estimate(F.col("x.sig"), F.col("y.sig"))).first()[0]
    assert abs(est - 90 / 110) < 0.12 and {tuple(r) for r in sketches.lsh_candidates(sets.where("sig is not null"), "key", "sig", 32, 4).collect()} == {("a", "b"), ("b", "a")}


def test_store(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    c, heard = db.collection("people"), []
    token = db.subscribe(lambda *e: heard.append(e))
    c.insert("a", {"n": 1, "tags": ["x"]})
    c.insert_batch([("b", {"n": 2}), ("c", {"n": 3, "v": Vector([0.8, 0.6])}), ("b", {"n": 22})])
    assert len(c) == 3 and c.get("b") == {"n": 22} and c.get("zz") is None and keys(c.scan()) == ["a", "b", "c"] and heard[0] == ("people", "a", "insert")
    c.insert("d", {"n": "text"})
    assert c.get("d") == {"n": "text"} and c.get("a")["n"] == 1 and n(c.frame(), field("n").gt(1)) == 2
    c.patch("a", {"m": True})
    assert c.get("a") == {"n": 1, "m": True, "tags": ["x"]}
    assert c.compare_and_set("b", {"n": 22}, {"n": 5}) and not c.compare_and_set("b", {"n": 5.0}, {"n": 6}) and c.compare_and_set("new", None, {"q": 1}) and not c.compare_and_set("new", None, {"q": 2}) and c.compare_and_set("new", {"q": 1}, None)
    assert c.delete("d") and not c.delete("d") and c.delete_where(field("n").eq(5)) == 1 and keys(c.scan()) == ["a", "c"]
    assert c.insert_auto({"n": 9}) == "0" * 19 + "1" and c.insert_auto({"n": 9}) == "0" * 19 + "2"
    rows, following = c.page(None, 2)
    assert keys(rows) == ["0" * 19 + "1", "0" * 19 + "2"] and following == "0" * 19 + "2" and keys(c.page(following, 5)[0]) == ["a", "c"] and c.page(following, 5)[1] is None and c.page(None, 0)[1] is None
    assert keys(c.page_where(None, 1, field("n").eq(1))[0]) == ["a"] and keys(c.prefix("0")) == ["0" * 19 + "1", "0" * 19 + "2"]
    seen = []
    c.for_each_doc(lambda k, d: seen.append(k) or len(seen) < 2)
    assert len(seen) == 2
    c.set_ttl("a", 100)
    c.insert_with_ttl("t", {"n": 1}, 200)
    assert c.ttl("a") == 100 and c.purge_expired(99) == 0 and c.purge_expired(100) == 1 and c.get("a") is None and c.ttl("t") == 200
    c.insert("t", {"n": 2})
    assert c.ttl("t") is None
    c.update("t", lambda d: {"n": d["n"] + 1})
    c.update("c", lambda d: None)
    assert c.get("t") == {"n": 3} and c.get("c") is None
    assert db.unsubscribe(token) and not db.unsubscribe(token) and db.changes().where("kind = 'delete'").count() >= 5
    for bad, e in (("__x", ReservedCollection), ("a__b", InvalidName)):
        with pytest.raises(e):
            db.collection(bad).insert("k", {})
    again = Database(spark, f"file://{tmp_path}/db")
    assert again.collections() == ["people"] and len(again.collection("people")) == 3
    again.compact()
    assert len(Database(spark, f"file://{tmp_path}/db").collection("people")) == 3


def test_schema(spark, tmp_path):
    c = Database(spark, f"file://{tmp_path}/db").collection("u")
    c.set_schema([FieldRule("name", "text", required=True), FieldRule("email", "text", unique=True), FieldRule("f", "vector")])
    c.insert("u1", {"name": "rocky", "email": "a@x", "f": Vector([1, 0])})
    for doc in ({"name": "zoe", "email": "a@x"}, {"email": "b@x"}, {"name": 5}, {"name": "p", "f": [1.0]}):
        with pytest.raises(SchemaViolation):
            c.insert("u2", doc)
    with pytest.raises(SchemaViolation):
        c.insert_batch([("u5", {"name": "p", "email": "q@x"}), ("u6", {"name": "q", "email": "q@x"})])
    assert len(c) == 1 and [r.name for r in c.schema()] == ["name", "email", "f"]
    c.insert("u1", {"name": "rocky", "email": "a@x", "extra": 1})
    c.insert("u3", {"name": "n", "email": None})
    c.insert("u4", {"name": "n"})
    assert len(c) == 3


def test_indexes_dump_and_tools(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    t = Tools(db)
    rng = np.random.default_rng(0)
    db.collection("d").insert_batch([(f"k{i:02d}", {"v": Vector(rng.normal(size=4).tolist()), "body": f"word{i % 5} common", "n": i, "fk": f"k{(i + 1) % 40:02d}", "loc": {"lat": float(i), "lon": float(i)}}) for i in range(40)])
    for tool, p in (("create_index", {"field": "v", "metric": "l2"}), ("create_text_index", {"field": "body"}), ("create_scalar_index", {"field": "n"}), ("create_compound_index", {"fields": ["n", "body"]}), ("create_geo_index", {"field": "loc"})):
        assert t.handle(tool, {"collection": "d", **p}) == {"ok": True}
    q = db.collection("d").query().vector("v", [1, 0, 0, 0], 3, "l2")
    assert q.plan_shape() == "ann" and len(keys(q.run())) == 3 and q.filter(field("n").lt(5)).plan_shape() == "streaming-topk" and len(keys(q.filter(field("n").lt(5)).run())) == 3
    assert [r.key for r in db.collection("d").text_search("body", "word1", 3).collect()] == ["k01", "k06", "k11"]
    assert [r["key"] for r in t.handle("phrase_search", {"collection": "d", "field": "body", "phrase": "word2 common", "k": 2})["rows"]] == ["k02", "k07"]
    found = t.handle("search", {"collection": "d", "filter": {"op": "and", "clauses": [{"op": "ge", "field": "n", "value": 3}, {"op": "not", "clause": {"op": "in", "field": "n", "values": [4]}}]}, "order_by": {"field": "n"}, "limit": 2, "select": ["n"]})
    assert [(r["key"], r["doc"]) for r in found["rows"]] == [("k03", {"n": 3}), ("k05", {"n": 5})]
    assert t.handle("join", {"collection": "d", "other": "d", "field": "fk", "limit": 1})["rows"][0]["right"]["key"] == "k01" and t.handle("count", {"collection": "d", "filter": {"op": "exists", "field": "n"}}) == {"count": 40}
    assert [r["key"] for r in t.handle("geo", {"collection": "d", "field": "loc", "kind": "nearest", "lat": 3, "lon": 3, "limit": 2})["rows"]] in (["k03", "k02"], ["k03", "k04"])
    t.handle("link", {"collection": "d", "src": "k01", "relation": "r", "dst": "k02"})
    t.handle("link", {"collection": "d", "src": "k02", "relation": "r", "dst": "k03"})
    assert t.handle("traverse", {"collection": "d", "key": "k01", "relation": "r", "hops": 2}) == {"keys": ["k02", "k03"]} and t.handle("in_neighbors", {"collection": "d", "key": "k02", "relation": "r"}) == {"keys": ["k01"]}
    t.handle("dump", {"path": f"file://{tmp_path}/dump"})
    assert t.handle("delete", {"collection": "d", "key": "k02"}) == {"deleted": 1} and t.handle("neighbors", {"collection": "d", "key": "k01", "relation": "r"}) == {"keys": []}
    other = Database(spark, f"file://{tmp_path}/other")
    other.load(f"file://{tmp_path}/dump", {"d": "e"})
    assert other.collections() == ["e"] and len(other.collection("e")) == 40 and keys(other.collection("e").neighbors("k01", "r")) == ["k02"]
    with pytest.raises(InvalidArgument):
        other.load(f"file://{tmp_path}/dump", {"d": "e"})
    db.backup(f"file://{tmp_path}/copy")
    assert len(Database(spark, f"file://{tmp_path}/copy").collection("d")) == 39
    with pytest.raises(BackupTargetExists):
        db.backup(f"file://{tmp_path}/copy")
    with pytest.raises(EmptyIndexTraining):
        db.collection("d").create_vector_index("v", m=3)
    with pytest.raises(InvalidArgument):
        t.handle("search", {"collection": "d", "limit": 5000})
    with pytest.raises(InvalidArgument):
        t.handle("nothing")
    assert t.handle("store", {"collection": "w", "key": "a", "doc": {"v": {"$vector": [1, 2]}, "b": {"$bytes": [1, 2]}, "n": 2.0}}) and t.handle("get", {"collection": "w", "key": "a"})["doc"] == {"v": [1.0, 2.0], "b": {"$bytes": [1, 2]}, "n": 2.0}
    assert t.handle("insert_auto", {"collection": "w", "doc": {"n": 1.0}})["key"].endswith("1") and t.handle("page", {"collection": "w", "limit": 1})["next"] == "0" * 19 + "1"
    assert t.handle("patch", {"collection": "w", "key": "a", "patch": {"n": 3.0}}) and t.handle("compare_and_set", {"collection": "w", "key": "zz", "new": {"n": 1.5}}) == {"swapped": True} and t.handle("delete_where", {"collection": "w", "filter": {"op": "eq", "field": "n", "value": 1.5}}) == {"deleted": 1}
    assert t.handle("set_schema", {"collection": "w", "fields": [{"name": "n", "type": "float"}]}) and t.handle("get_schema", {"collection": "w"})["fields"][0]["type"] == "float" and t.handle("list_collections")["collections"] == ["d", "w"] and t.handle("unlink", {"collection": "d", "src": "x", "relation": "r", "dst": "y"}) == {"removed": False}
    assert len(t.names()) == 29
    json.dumps(found)


def test_json_filters(docs):
    for tree in ({}, {"op": "and", "clauses": []}, {"op": "nope"}, {"op": "eq", "field": "n"}, {"op": "in", "field": "n", "values": 3}, {"op": "starts_with", "field": "n", "value": 3}, {"op": "not"}):
        with pytest.raises(InvalidArgument):
            from_json(tree)
    assert n(docs, from_json({"op": "between", "field": "n", "low": 0.5, "high": 2})) == 3


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderkey", "key")
    p = field("o_orderstatus").eq("F") & field("o_totalprice").gt(1000.0) & ~field("o_orderpriority").eq("x")
    plan = df.where(p.condition(df)).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan, plan[:1500]


def test_change_stream(spark, tmp_path):
    from heronlake.streaming.changes import change_stream, sessions, windowed_counts

    db = Database(spark, f"file://{tmp_path}/db")
    db.collection("s").insert_batch([("a", {"n": 1}), ("b", {"n": 2})])
    query = change_stream(spark, f"file://{tmp_path}/db").writeStream.format("memory").queryName("feed").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    db.collection("s").delete("a")
    query.processAllAvailable()
    query.stop()
    assert {(r.key, r.kind) for r in spark.table("feed").collect()} == {("a", "insert"), ("b", "insert"), ("a", "delete")}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count() == sessions(events).agg(F.sum("n")).first()[0]
