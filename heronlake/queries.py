"""The engine's queries over the test tables and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sketches
from .functions.text import STOP_WORDS, Analyzer, stem, tokenize
from .operators import aggregates, geo, graph, joins, text, vector
from .operators.order import kept, placed
from .plans.predicates import Predicate, field, from_json
from .plans.query import Query, projected
from .shared import shared_dir, ship
from .sources.schema import FieldRule, violations
from .sources.store import Database
from .streaming.changes import sessions, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; ``key`` names the column that becomes the documents' key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if key is None else df.withColumnRenamed(key, "key")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return put


def _filtered(name: str, source: str, key: str, columns: list[str], p: Predicate, sql: str) -> None:
    def run(spark, sf_dir):
        return Query(table(spark, sf_dir, source, key)).filter(p).run().select("key", *columns)

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join([key + ' AS key', *columns])} FROM {source} WHERE coalesce({sql}, false)"


# Predicates.
_filtered("filter_eq_and_or_not", "orders", "o_orderkey", ["o_orderstatus", "o_totalprice"], (field("o_orderstatus").eq("F") & ~field("o_orderpriority").eq("1-URGENT")) | field("o_totalprice").gt(300000), "(o_orderstatus = 'F' AND NOT o_orderpriority = '1-URGENT') OR o_totalprice > 300000")
_filtered("filter_in", "part", "p_partkey", ["p_size", "p_brand"], field("p_size").is_in([1, 7, 49, "x", 3.0]), "p_size IN (1, 7, 49, 3)")
_filtered("filter_between", "customer", "c_custkey", ["c_acctbal"], field("c_acctbal").between(0, 1500.5), "c_acctbal BETWEEN 0 AND 1500.5")
_filtered("filter_starts_with", "part", "p_partkey", ["p_type"], field("p_type").starts_with("S"), "starts_with(p_type, 'S')")
_filtered("filter_contains", "part", "p_partkey", ["p_name"], field("p_name").contains("ed "), "contains(p_name, 'ed ')")
_filtered("filter_ranges", "lineitem", "l_orderkey", ["l_linenumber", "l_quantity"], field("l_quantity").ge(45) & field("l_quantity").lt(50) & field("l_returnflag").ne("N") & field("l_discount").le(0.05), "l_quantity >= 45 AND l_quantity < 50 AND l_returnflag <> 'N' AND l_discount <= 0.05")
_filtered("filter_other_kind", "orders", "o_orderkey", ["o_orderstatus"], ~field("o_orderstatus").eq(7) & field("o_custkey").ne("7") & ~field("nothing").exists(), "true")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id").select("key", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels", "doc_id").select("key", "quality", "toxic"), "key", "left")


@query("SELECT d.doc_id AS key FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.quality <> 1")
def filter_ne_missing(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.where(field("quality").ne(1).condition(df)).select("key")


@query("SELECT d.doc_id AS key FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality = 1 OR l.toxic = 1, false)")
def filter_not_missing(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.where((~(field("quality").eq(1) | field("toxic").eq(1))).condition(df)).select("key")


@query("SELECT d.doc_id AS key FROM documents d JOIN labels l USING (doc_id)")
def filter_exists(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.where(field("quality").exists().condition(df)).select("key")


@query("SELECT o_orderkey AS key FROM orders WHERE (o_orderstatus IN ('F', 'P') AND NOT starts_with(o_orderpriority, '5')) OR o_totalprice BETWEEN 10 AND 20000")
def filter_json(spark, sf_dir):
    tree = {"op": "or", "clauses": [{"op": "and", "clauses": [{"op": "in", "field": "o_orderstatus", "values": ["F", "P"]}, {"op": "not", "clause": {"op": "starts_with", "field": "o_orderpriority", "value": "5"}}]}, {"op": "between", "field": "o_totalprice", "low": 10, "high": 20000}]}
    df = table(spark, sf_dir, "orders", "o_orderkey")
    return df.where(from_json(tree).condition(df)).select("key")


# Scans, pages, projection, order.


@query("SELECT o_orderkey AS key, o_totalprice FROM orders")
def scan(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders", "o_orderkey")).run().select("key", "o_totalprice")


@query("SELECT o_orderkey AS key, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_get(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey").where("key = 7").select("key", "o_totalprice")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 50")
def page_keyset(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey").where("key > 100").select("key").orderBy("key").limit(50)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'O' ORDER BY 1 LIMIT 50")
def page_filtered(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey")
    return df.where(F.col("key") > 100).where(field("o_orderstatus").eq("O").condition(df)).select("key").orderBy("key").limit(50)


@query("SELECT l_orderkey AS key, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 20 OFFSET 10")
def order_limit_offset(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem", "l_orderkey")).order_by("l_extendedprice", True).offset(10).limit(20).run().select("key", "l_extendedprice")


@query("SELECT row_number() OVER (ORDER BY (quality IS NULL), quality DESC, doc_id) AS place, doc_id AS key FROM documents LEFT JOIN labels USING (doc_id)")
def order_by_classes(spark, sf_dir):
    return placed(Query(_labelled(spark, sf_dir)).order_by("quality", True).run().select("key")).select("place", "key")


@query("SELECT doc_id AS key, source AS meta_source, lang AS meta_lang FROM documents WHERE n_chars > 2000")
def select_nested(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id").select("key", "n_chars", F.struct("source", "lang", "n_chars").alias("meta"))
    rows = df.where(field("n_chars").gt(2000).condition(df))
    return rows.select("key", *projected(rows, ("meta.source", "meta.lang"))).select("key", F.col("meta.source").alias("meta_source"), F.col("meta.lang").alias("meta_lang"))


# Aggregates.


@query("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10")
def count(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem", "l_orderkey")).filter(field("l_returnflag").eq("R") & field("l_quantity").gt(10)).count()


@query("SELECT round(sum(l_extendedprice), 2) AS sum FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def sum_of(spark, sf_dir):
    import datetime as dt

    q = Query(table(spark, sf_dir, "lineitem", "l_orderkey")).filter(field("l_shipdate").ge(dt.datetime(1995, 1, 1)))
    return q.sum("l_extendedprice").select(F.round("sum", 2).alias("sum"))


@query("SELECT round(avg(l_discount), 6) AS avg FROM lineitem")
def avg_of(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem", "l_orderkey")).avg("l_discount").select(F.round("avg", 6).alias("avg"))


@query("SELECT 'min' AS what, min(o_totalprice) AS number, NULL::VARCHAR AS text FROM orders UNION ALL SELECT 'max', NULL, max(o_orderpriority) FROM orders")
def min_max(spark, sf_dir):
    q = Query(table(spark, sf_dir, "orders", "o_orderkey"))
    least = q.min("o_totalprice").select(F.lit("min").alias("what"), F.col("min").alias("number"), F.lit(None).cast("string").alias("text"))
    return least.unionByName(q.max("o_orderpriority").select(F.lit("max").alias("what"), F.lit(None).cast("double").alias("number"), F.col("max").alias("text")))


@query("SELECT count(DISTINCT l_partkey) AS count_distinct FROM lineitem")
def count_distinct(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem", "l_orderkey")).count_distinct("l_partkey")


@query("""SELECT 'i:' || l_linenumber AS "group", count(*) AS count FROM lineitem GROUP BY 1""")
def group_count(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem", "l_orderkey")).group_count("l_linenumber")


@query("""SELECT event_type AS "group", round(sum(value), 4) AS sum FROM events WHERE value > 1 GROUP BY 1""")
def group_sum(spark, sf_dir):
    out = Query(table(spark, sf_dir, "events", "event_id")).filter(field("value").gt(1)).group_sum("event_type", "value")
    return out.select("group", F.round("sum", 4).alias("sum"))


@query("""SELECT o_orderpriority AS "group", round(avg(o_totalprice), 4) AS avg FROM orders GROUP BY 1""")
def group_avg(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders", "o_orderkey")).group_avg("o_orderpriority", "o_totalprice").select("group", F.round("avg", 4).alias("avg"))


@query("""SELECT 'f:' || CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(printf('%.2f', l_discount), '0') END AS "group", count(*) AS count FROM lineitem GROUP BY 1""")
def group_count_floats(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem", "l_orderkey")).group_count("l_discount")


@query("SELECT count(DISTINCT user_id) AS exact, true AS within FROM events")
def approx_distinct(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id")
    got = df.agg(sketches.approx_distinct(F.col("user_id")).alias("about"), F.count_distinct("user_id").alias("exact"))
    return got.select("exact", (F.abs(F.col("about") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


# Joins.


@query("SELECT o.o_orderkey AS key, c.c_name AS name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def join_fk(spark, sf_dir):
    out = joins.lookup(table(spark, sf_dir, "orders", "o_orderkey"), table(spark, sf_dir, "customer", "c_custkey"), "o_custkey")
    return out.select("key", F.col("right.c_name").alias("name"))


@query("SELECT d.doc_id AS key, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_fk_missing(spark, sf_dir):
    left = table(spark, sf_dir, "documents", "doc_id").select("key", F.col("key").alias("fk"))
    return joins.lookup(left, table(spark, sf_dir, "labels", "doc_id"), "fk").select("key", F.col("right.quality").alias("quality"))


# Vectors.


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id")


def _vector(df: DataFrame, key: int = 0) -> list[float]:
    return df.where(F.col("key") == key).first().embedding


_DISTANCE = {
    "cosine": "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "dot": "-list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "l2": "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2",
}


def _knn(metric: str) -> None:
    def run(spark, sf_dir):
        df = _vectors(spark, sf_dir)
        return vector.exact(df, "embedding", _vector(df), 10, metric).select("key", F.round("distance", 6).alias("distance"))

    QUERIES[f"knn_{metric}"] = run
    SQL[f"knn_{metric}"] = f"SELECT e.vec_id AS key, round({_DISTANCE[metric]}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DISTANCE[metric]}, e.vec_id LIMIT 10"


for _m in _DISTANCE:
    _knn(_m)


@query(f"SELECT e.vec_id AS key, round(1.0 / (60 + row_number() OVER (ORDER BY {_DISTANCE['cosine']}, e.vec_id)), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label <= 2 ORDER BY score DESC LIMIT 10")
def knn_filtered(spark, sf_dir):
    """The flagship: metadata filter, then exact nearest neighbours of what is left, through the builder."""
    df = _vectors(spark, sf_dir)
    out = Query(df).filter(field("label").le(2)).vector("embedding", _vector(df), 10).limit(10).run()
    return out.select("key", F.round("score", 9).alias("score"))


@query(f"SELECT q.vec_id AS query, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE['l2']}, e.vec_id) AS INT) AS rank, e.vec_id AS key FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5")
def knn_batch(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    queries = [(r.key, r.embedding) for r in df.where("key % 100 = 0").collect()]
    return vector.batch(df, "embedding", queries, 5, "l2").select("query", "rank", "key")


def _asked(df: DataFrame) -> list[tuple]:
    return [(r.key, r.embedding) for r in df.where("key % 100 = 0").collect()]


def _recalled(df: DataFrame, found: DataFrame, queries: list[tuple]) -> DataFrame:
    """For each query its nearest row as found, how many rows were found, and whether the mean recall of all queries' 10 nearest is 0.9 or more."""
    want = vector.batch(df, "embedding", queries, 10, "l2").select("query", "key")
    hit = want.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    enough = hit.agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough")).first().enough
    first = found.groupBy("query").agg(F.min_by("key", "rank").alias("nearest"), F.count(F.lit(1)).alias("n_found"))
    return first.withColumn("enough", F.lit(enough))


_RECALLED = "SELECT vec_id AS query, vec_id AS nearest, 10 AS n_found, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


@query(_RECALLED)
def knn_binary(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    queries = _asked(df)
    return _recalled(df, vector.batch_by_codes(df, "embedding", queries, 10, "l2", "binary"), queries)


@query(_RECALLED)
def knn_scalar(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    queries = _asked(df)
    return _recalled(df, vector.batch_by_codes(df, "embedding", queries, 10, "l2", "scalar"), queries)


@query(_RECALLED)
def knn_pq(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    pq = vector.train_pq(df, "embedding", 8, 32)
    queries = _asked(df)
    return _recalled(df, vector.batch_by_pq(vector.with_pq(df, "embedding", pq), "embedding", pq, queries, 10, "l2"), queries)


@query(_RECALLED)
def knn_cells(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    lists = vector.InvertedLists.train(df, "embedding", "l2", 16)
    queries = _asked(df)
    return _recalled(df, lists.search_batch(lists.assign(df, "embedding"), "embedding", queries, 10), queries)


@query(f"SELECT q.vec_id AS query, e.vec_id AS key FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id % 100 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE['l2']}, e.vec_id) = 1 AND {_DISTANCE['l2']} <= 1.5")
def semantic_cache(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    held = df.where("key % 100 <> 0").select("key", "embedding", F.col("label").alias("value"))
    queries = [(r.key, r.embedding) for r in df.where("key % 100 = 0").collect()]
    return vector.SemanticCache(held, "l2", 1.5).get_batch(queries).select("query", "key")


# Text.

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STEM = "CASE WHEN length(x) <= 3 OR regexp_matches(x, '[^\\x00-\\x7F]') THEN x WHEN regexp_matches(x, '[^ae]ies$') THEN x[:-4] || 'y' WHEN regexp_matches(x, 's$') AND NOT regexp_matches(x, '[us]s$') THEN x[:-2] ELSE x END"
_ANALYZED = f"list_transform(list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP})), lambda x: {_STEM})"


@query(f"SELECT doc_id AS key, list_aggregate({_TOKENS}, 'string_agg', ' ') AS tokens FROM documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").select("key", F.nullif(F.array_join(tokenize(F.col("text")), " "), F.lit("")).alias("tokens"))


@query(f"SELECT x AS word, {_STEM} AS stem FROM (SELECT DISTINCT unnest({_TOKENS}) AS x FROM documents)")
def stems(spark, sf_dir):
    words = table(spark, sf_dir, "documents", "doc_id").select(F.explode(tokenize(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem(F.col("word")).alias("stem"))


_TERMS = ("tion", "anre", "erth")


def _bm25(where: str, terms: tuple[str, ...] = _TERMS, phrase: bool = False) -> str:
    tf = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in terms]
    each = range(len(terms))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg)) ELSE 0 END" for i in each)
    which = f"contains(' ' || array_to_string(t, ' ') || ' ', ' {' '.join(terms)} ')" if phrase else "true"
    return f"""WITH d AS (SELECT doc_id AS key, {_ANALYZED} AS t FROM documents WHERE text IS NOT NULL AND {where}),
        c AS (SELECT key, len(t) AS len, {which} AS hit, {', '.join(f'{x} AS tf{i}' for i, x in enumerate(tf))} FROM d),
        s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg, {', '.join(f'count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}' for i in each)} FROM c),
        r AS (SELECT key, {score} AS score FROM c, s WHERE hit)
        SELECT key, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, key {'' if phrase else 'LIMIT 20'}"""


@query(_bm25("true"))
def bm25_search(spark, sf_dir):
    out = text.search(table(spark, sf_dir, "documents", "doc_id"), "text", " ".join(_TERMS), 20)
    return out.select("key", F.round("score", 6).alias("score"))


@query(_bm25("lang = 'en'"))
def bm25_filtered(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id")
    return text.search(df.where(field("lang").eq("en").condition(df)), "text", " ".join(_TERMS), 20).select("key", F.round("score", 6).alias("score"))


@query(_bm25("true", ("apache", "license"), True))
def phrase_search(spark, sf_dir):
    return text.phrase(table(spark, sf_dir, "documents", "doc_id"), "text", "Apache License", None).select("key", F.round("score", 6).alias("score"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_ANALYZED}) AS term FROM documents) GROUP BY term")
def postings(spark, sf_dir):
    rows = text.postings(table(spark, sf_dir, "documents", "doc_id"), "text", Analyzer())
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


# Fusion.

_FUSED = f"""WITH b AS ({_bm25("true")}), t AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM b),
    v AS (SELECT e.vec_id AS key, row_number() OVER (ORDER BY {_DISTANCE['cosine']}, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id IN (SELECT doc_id FROM documents) QUALIFY r <= 20)
    SELECT key, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY key"""


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    docs, vecs = table(spark, sf_dir, "documents", "doc_id"), _vectors(spark, sf_dir)
    return docs.join(vecs.select("key", "embedding"), "key", "left"), _vector(vecs)


@query(_FUSED)
def rrf_hybrid(spark, sf_dir):
    df, q = _hybrid(spark, sf_dir)
    out = Query(df).text("text", " ".join(_TERMS), 20).vector("embedding", q, 20).run()
    return out.select("key", F.round("score", 9).alias("score"))


# The first ten of the greedy order: of the fused rows those with a vector, of which there are 20 at least, come before the others.
@query(f"""WITH RECURSIVE fused AS ({_FUSED}), u AS (SELECT f.key, f.score, e.embedding FROM fused f JOIN embeddings e ON e.vec_id = f.key),
    near AS (SELECT u.key, u.score, -{_DISTANCE["cosine"].replace("e.", "u.")} AS near FROM u, embeddings q WHERE q.vec_id = 0),
    sims AS (SELECT e.key AS key, map(list(q.key), list(-{_DISTANCE["cosine"]})) AS sim FROM u e, u q GROUP BY e.key),
    r(n, chosen) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT n + 1, list_append(chosen, key) FROM (
        SELECT r.n, r.chosen, near.key, row_number() OVER (ORDER BY 0.5 * near.near - 0.5 * coalesce(list_max(list_transform(r.chosen, lambda c: sims.sim[c])), 0) DESC, near.key) AS place
        FROM r, near JOIN sims USING (key) WHERE r.n < 10 AND NOT list_contains(r.chosen, near.key)) WHERE place = 1)
    SELECT key, round(score, 9) AS score FROM near WHERE list_contains((SELECT chosen FROM r WHERE n = 10), key)""")
def mmr_rerank(spark, sf_dir):
    df, q = _hybrid(spark, sf_dir)
    return Query(df).text("text", " ".join(_TERMS), 20).vector("embedding", q, 20).rerank_mmr(0.5).limit(10).run().select("key", F.round("score", 9).alias("score"))


# Geo: customers have no places, so a formula gives them some.

_LAT, _LON = "(c_custkey * 7919 % 17000) / 100.0 - 85", "(c_custkey * 104729 % 36000) / 100.0 - 180"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", f"struct(cast({_LAT} AS double) AS lat, cast({_LON} AS double) AS lon) AS loc")
    return df


def _km(lat: float, lon: float) -> str:
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - {lon}) / 2), 2))))"


_PLACES = f"(SELECT c_custkey AS key, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon FROM customer)"


@query(f"SELECT key FROM {_PLACES} WHERE {_km(10.0, 20.0)} <= 2500")
def filter_within_km(spark, sf_dir):
    df = _places(spark, sf_dir)
    return df.where(field("loc").within_km(10.0, 20.0, 2500).condition(df)).select("key")


@query(f"SELECT key, round({_km(50.0, -60.0)}, 5) AS distance_km FROM {_PLACES} WHERE {_km(50.0, -60.0)} <= 3000")
def geo_radius(spark, sf_dir):
    return geo.radius(_places(spark, sf_dir), "loc", 50.0, -60.0, 3000).select("key", F.round("distance_km", 5).alias("distance_km"))


@query(f"SELECT key, round({_km(-33.0, 151.0)}, 5) AS distance_km FROM {_PLACES} ORDER BY {_km(-33.0, 151.0)}, key LIMIT 15")
def geo_nearest(spark, sf_dir):
    return geo.nearest(_places(spark, sf_dir), "loc", -33.0, 151.0, 15).select("key", F.round("distance_km", 5).alias("distance_km"))


@query(f"SELECT key FROM {_PLACES} WHERE lat BETWEEN 20 AND 50 AND lon BETWEEN -10 AND 40")
def geo_box(spark, sf_dir):
    return geo.box(_places(spark, sf_dir), "loc", 20, -10, 50, 40).select("key")


@query(f"SELECT key FROM {_PLACES} WHERE lat BETWEEN -40 AND 40 AND (lon >= 150 OR lon <= -150)")
def geo_box_wrapped(spark, sf_dir):
    return geo.box(_places(spark, sf_dir), "loc", -40, 150, 40, -150).select("key")


# Graph: a customer's orders, an order's parts.

_EDGES = "(SELECT 'r' AS relation, l_orderkey AS src, -l_partkey AS dst, l_quantity AS weight FROM lineitem UNION ALL SELECT 'r', -l_partkey, l_orderkey + 1, 1.0 FROM lineitem WHERE l_linenumber = 1)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    there = items.selectExpr("'r' AS relation", "l_orderkey AS src", "-l_partkey AS dst", "l_quantity AS weight")
    return there.unionByName(items.where("l_linenumber = 1").selectExpr("'r' AS relation", "-l_partkey AS src", "l_orderkey + 1 AS dst", "1.0D AS weight"))


@query(f"SELECT DISTINCT dst AS key FROM {_EDGES} WHERE src = 1")
def neighbors(spark, sf_dir):
    return graph.neighbors(_edges(spark, sf_dir), 1, "r")


@query(f"SELECT DISTINCT src AS key FROM {_EDGES} WHERE dst = -5")
def in_neighbors(spark, sf_dir):
    return graph.in_neighbors(_edges(spark, sf_dir), -5, "r")


@query(f"SELECT dst AS key, weight FROM {_EDGES} WHERE src = 3")
def neighbors_weighted(spark, sf_dir):
    return graph.neighbors_weighted(_edges(spark, sf_dir), 3, "r")


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), r(key, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.key WHERE r.hop < 4) SELECT key, min(hop) AS hop FROM r GROUP BY key HAVING min(hop) > 0")
def traverse(spark, sf_dir):
    return graph.traverse(_edges(spark, sf_dir), 1, "r", 4).select("key", "hop")


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), r(key, hop) AS (SELECT 2::BIGINT, 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.key WHERE r.hop < 3) SELECT key, min(hop) AS hop FROM r GROUP BY key HAVING min(hop) > 0")
def reachable(spark, sf_dir):
    return graph.reachable(_edges(spark, sf_dir).distinct(), 2, "r", 3)


# Sketches.


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS held_found, true AS few_false FROM orders")
def bloom_member(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    bloom = sketches.BloomFilter.build(orders.where("o_orderstatus = 'F'"), "o_orderkey", max(1, orders.count()), 0.01)
    tested = bloom.test(orders, "o_orderkey")
    held = F.col("o_orderstatus") == "F"
    return tested.agg(F.count(F.when(held & F.col("maybe"), 1)).alias("held_found"), (F.avg(F.when(~held, F.col("maybe").cast("int"))) < 0.05).alias("few_false"))


@query("SELECT count(*) FILTER (p_size <= 25) AS held_found, true AS few_false FROM part")
def cuckoo_member(spark, sf_dir):
    """The filter is a driver object, filled from a stream of keys; the frame is tested by an Arrow UDF."""
    part = table(spark, sf_dir, "part")
    mine = sketches.CuckooFilter(part.count())
    for r in part.where("p_size <= 25").select("p_partkey").toLocalIterator():
        mine.add(str(r[0]).encode())
    ship(spark)

    @F.pandas_udf("boolean")
    def has(x):
        return x.map(lambda v: mine.has(str(v).encode()))

    tested = part.withColumn("maybe", has("p_partkey"))
    held = F.col("p_size") <= 25
    return tested.agg(F.count(F.when(held & F.col("maybe"), 1)).alias("held_found"), (F.avg(F.when(~held, F.col("maybe").cast("int"))) < 0.05).alias("few_false"))


_SHARES = (0.01, 0.1, 0.5, 0.9, 0.99)


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS share, round(quantile_cont(l_extendedprice, {q}), 4) AS exact, true AS within FROM lineitem" for q in _SHARES))
def quantiles(spark, sf_dir):
    """Exact quantiles, and whether the digest's are between those of shares a hundredth lower and higher."""
    df = table(spark, sf_dir, "lineitem")
    digest = sketches.TDigest.build(df, "l_extendedprice")
    found = spark.createDataFrame([(q, digest.quantile(q)) for q in _SHARES], "share double, about double")
    shares = [x for q in _SHARES for x in (max(q - 0.01, 0.0), q, min(q + 0.01, 1.0))]
    true = df.agg(F.expr(f"percentile(l_extendedprice, array({', '.join(map(repr, shares))}))").alias("e"))
    rows = true.select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), *[F.get("e", F.lit(3 * i + j)).alias(n) for j, n in enumerate(("low", "exact", "high"))]) for i, q in enumerate(_SHARES)])).alias("r")).select("r.*")
    return rows.join(F.broadcast(found), "share").select("share", F.round("exact", 4).alias("exact"), F.col("about").between(F.col("low"), F.col("high")).alias("within"))


_SHINGLES = """SELECT doc_id AS key, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\t-\\r ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH s AS ({_SHINGLES}), n AS (SELECT key, count(*) AS n FROM s GROUP BY key),
    c AS (SELECT a.key AS probe, b.key AS key, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s WHERE a.key % 100 = 0 AND a.key <> b.key GROUP BY ALL)
    SELECT probe, c.key, n_both, x.n + y.n - n_both AS n_either FROM c JOIN n x ON x.key = probe JOIN n y ON y.key = c.key WHERE 4 * n_both >= 3 * (x.n + y.n - n_both)""")
def minhash_lsh(spark, sf_dir):
    """For every text with an id divisible by 100, the texts that share three quarters of its five-word shingles: bands give candidates, sets of hashes decide."""
    docs = text.spread(table(spark, sf_dir, "documents", "doc_id").where("text is not null"))
    words = docs.select("key", F.filter(F.split(F.lower("text"), "[\\t-\\r ]+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1)))
    sets = words.select("key", F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, F.lit(5))))).alias("s"))
    sets = kept(sets.withColumn("sig", sketches.minhash(F.col("s"), 128)))
    found = sketches.lsh_candidates(sets, "key", "sig", 32, 4, sets.where("key % 100 = 0"))
    mine = found.join(sets.select(F.col("key").alias("probe"), F.col("s").alias("a")), "probe").join(sets.select("key", F.col("s").alias("b")), "key")
    both = mine.select("probe", "key", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), (F.size("a") + F.size("b")).alias("sum"))
    return both.select("probe", "key", "n_both", (F.col("sum") - F.col("n_both")).alias("n_either")).where("4 * n_both >= 3 * n_either")


# Mutations, as frames before and after.


@query("SELECT event_id AS key FROM events WHERE NOT (event_id + 100 <= 600)")
def ttl_purge(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id")
    expiry = df.select("key", (F.col("key") + 100).alias("expires_at"))
    return df.join(expiry.where(F.col("expires_at") <= 600).select("key"), "key", "left_anti").select("key")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def patch_merge(spark, sf_dir):
    from .sources.documents import union

    df = table(spark, sf_dir, "customer", "c_custkey")
    new = df.where("key % 10 = 0").withColumn("c_mktsegment", F.lit("PATCHED"))
    return union(df.join(new.select("key"), "key", "left_anti"), new).select("key", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey AS key FROM customer WHERE NOT coalesce(c_acctbal < 0 OR c_mktsegment = 'BUILDING', false)")
def delete_where(spark, sf_dir):
    df = table(spark, sf_dir, "customer", "c_custkey")
    return df.where((~(field("c_acctbal").lt(0) | field("c_mktsegment").eq("BUILDING"))).condition(df)).select("key")


@query("SELECT min(o_orderkey)::VARCHAR AS key, 'o_custkey' AS field, 'unique' AS problem FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT o_orderkey::VARCHAR, 'o_orderstatus', 'type' FROM orders")
def schema_violations(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey")
    rules = [FieldRule("o_custkey", "int", unique=True), FieldRule("o_orderstatus", "int"), FieldRule("o_totalprice", "float", required=True)]
    return violations(df, None, rules).select(F.col("key").cast("string").alias("key"), "field", "problem")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"))


# The store: each query writes a database of its own to the shared folder and returns what it holds in the end.


def _database(spark: SparkSession) -> Database:
    return Database(spark, f"{shared_dir(spark).rstrip('/')}/heronlake-db-{uuid.uuid4().hex}")


def _customers(spark: SparkSession, sf_dir: str):
    c = _database(spark).collection("customers")
    c.put(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment", "c_acctbal"))
    return c


_CUSTOMERS = "SELECT c_custkey::VARCHAR AS key, c_mktsegment, c_acctbal FROM customer"


@query("""SELECT c_custkey::VARCHAR AS key, CASE c_custkey WHEN 7 THEN 'PATCHED' WHEN 9 THEN 'SWAPPED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer
    UNION ALL SELECT 'new', 'ADDED', 1.5 UNION ALL SELECT '00000000000000000001', 'NUMBERED', 2.5""")
def store_writes(spark, sf_dir):
    """insert, insert_auto, patch, and compare_and_set that holds and that doesn't."""
    c = _customers(spark, sf_dir)
    c.insert("new", {"c_mktsegment": "ADDED", "c_acctbal": 1.5})
    c.insert_auto({"c_mktsegment": "NUMBERED", "c_acctbal": 2.5})
    c.patch("7", {"c_mktsegment": "PATCHED"})
    c.compare_and_set("8", {"c_mktsegment": "other"}, {"c_mktsegment": "LOST"})
    held = c.get("9")
    c.compare_and_set("9", held, held | {"c_mktsegment": "SWAPPED"})
    return c.frame().select("key", "c_mktsegment", "c_acctbal")


@query(_CUSTOMERS + " WHERE NOT c_acctbal < 0 AND c_custkey NOT IN (3, 4)")
def store_deletes(spark, sf_dir):
    c = _customers(spark, sf_dir)
    c.delete_where(field("c_acctbal").lt(0))
    c.delete_batch(["3", "4", "none"])
    return c.frame().select("key", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey::VARCHAR AS key, (CASE WHEN c_custkey % 5 = 0 THEN c_custkey END) AS expires_at FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey <= 600)")
def store_expiry(spark, sf_dir):
    c = _customers(spark, sf_dir)
    c.put(c.frame(), expiries=c.frame().select("key", F.col("key").cast("long").alias("expires_at")).where("expires_at % 5 = 0"))
    c.purge_expired(600)
    return c.frame().select("key").join(c._ttl(), "key", "left")


@query("SELECT c_custkey::VARCHAR AS key FROM customer WHERE c_custkey::VARCHAR > '2' AND c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 40")
def store_page(spark, sf_dir):
    rows, _ = _customers(spark, sf_dir).page_where("2", 40, field("c_mktsegment").eq("BUILDING"))
    return rows.select("key")


@query("SELECT c_custkey::VARCHAR AS key FROM customer WHERE starts_with(c_custkey::VARCHAR, '12')")
def store_prefix(spark, sf_dir):
    return _customers(spark, sf_dir).prefix("12").select("key")


@query(_CUSTOMERS)
def store_dump_load(spark, sf_dir):
    """Dumped, and loaded into another database under another name."""
    c, other = _customers(spark, sf_dir), _database(spark)
    c.db.dump(f"{other.root}-dump")
    other.load(f"{other.root}-dump", {"customers": "people"})
    return other.collection("people").frame().select("key", "c_mktsegment", "c_acctbal")


@query("""SELECT 1 AS version, 'insert' AS kind, count(*) AS n, min(c_custkey::VARCHAR) AS first FROM customer
    UNION ALL SELECT 2, 'insert', 1, '7' UNION ALL SELECT 3, 'delete', count(*), min(c_custkey::VARCHAR) FROM customer WHERE c_acctbal < 0 AND c_custkey <> 7""")
def store_changes(spark, sf_dir):
    c = _customers(spark, sf_dir)
    c.patch("7", {"c_acctbal": 5.0})
    c.delete_where(field("c_acctbal").lt(0))
    return c.db.changes().groupBy("version", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@query(f"SELECT q.vec_id::VARCHAR AS query, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE['l2']}, e.vec_id::VARCHAR) AS INT) AS rank, e.vec_id::VARCHAR AS key FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5")
def store_vector_index(spark, sf_dir):
    """Through an index of scalar codes, whose candidates held every neighbour wherever it was measured (README)."""
    df = _vectors(spark, sf_dir)
    c = _database(spark).collection("vectors")
    c.put(df.select(F.col("key").cast("string").alias("key"), "embedding"))
    c.create_vector_index("embedding", "l2", codes="scalar")
    return c.vector_search_batch("embedding", [(str(k), v) for k, v in _asked(df)], 5).select("query", "rank", "key")


@query(_bm25("true").replace("doc_id AS key", "doc_id::VARCHAR AS key"))
def store_text_index(spark, sf_dir):
    c = _database(spark).collection("texts")
    c.put(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"))
    c.create_text_index("text")
    return c.text_search("text", " ".join(_TERMS), 20).select("key", F.round("score", 6).alias("score"))


@query(_bm25("true", ("apache", "license"), True).replace("doc_id AS key", "doc_id::VARCHAR AS key"))
def store_phrase_index(spark, sf_dir):
    c = _database(spark).collection("texts")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    c.put(docs)
    c.create_text_index("text")
    return c.phrase_search("text", "Apache License", len(c)).select("key", F.round("score", 6).alias("score"))


@query("SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS key FROM customer WHERE c_custkey <> 5 AND c_nationkey <> 3")
def store_edges(spark, sf_dir):
    """Edges linked in bulk, one unlinked, and those of a deleted document gone with it."""
    c = _database(spark).collection("of")
    rows = table(spark, sf_dir, "customer")
    c._edges_put(rows.selectExpr("'in' AS relation", "concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst", "1.0D AS weight"))
    one = rows.where("c_custkey = 5").first()
    c.unlink("c5", "in", f"n{one.c_nationkey}")
    c.delete("n3")
    return c.edges().select("src", F.col("dst").alias("key"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

