"""BM25 and phrase search over a frame, or over a written postings table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import let, resolve, text_of
from ..functions.text import Analyzer, Bm25


def terms_of(spark, analyzer: Analyzer, query: str) -> list[str]:
    """The query's analysed terms, in order, with repeats."""
    return spark.range(1).select(analyzer.analyze(F.lit(query))).first()[0]


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where there are fewer files than cores, as a small file is one task; large inputs stay as they are."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    return df.repartition(cores) if 0 < len(files) < cores else df


def _corpus(df: DataFrame, field: str, analyzer: Analyzer, stems: bool = True) -> DataFrame | None:
    """df's rows whose field is text, with their tokens in _tok, stemmed or not. Empty texts count."""
    at, kind = resolve(df, field)
    if at is None:
        return None
    text = text_of(at, kind)
    return spread(df.where(text.isNotNull())).withColumn("_tok", analyzer.analyze(text) if stems else analyzer.words(text))


def _counted(docs: DataFrame, field: str, terms: list[list[str]], needed, hit=None) -> DataFrame:
    """docs that may match, with _len, _tf (one count for each term, given by its forms) and _hit (of the tokens), and the corpus's _n, _avg and _df beside each row.

    Statistics are those of all docs. A token is a part of its text in lower case, so texts without any form of a term (of
    every term, where ``needed`` is all) are left out unread by a plain search. One row of statistics is joined by a constant,
    so it is the only thing that is broadcast.
    """
    spelled = list(dict.fromkeys(w for t in terms for w in t))

    def counts(tok: Column) -> Column:
        count = lambda few, t: F.size(F.filter(few, lambda x: x.isin(*t)))
        # One pass over all tokens; each term is then counted among the few that are some term's.
        tf = let(F.filter(tok, lambda x: x.isin(*spelled)), lambda few: F.array(*[count(few, t) for t in terms]))
        return F.struct(F.size(tok).alias("len"), tf.alias("tf"), (F.lit(True) if hit is None else hit(tok)).alias("hit"))

    def count_of(some: DataFrame) -> DataFrame:
        return some.withColumn("_c", let(F.col("_tok"), counts)).withColumns({"_len": F.col("_c.len"), "_tf": F.col("_c.tf"), "_hit": F.col("_c.hit")}).drop("_tok", "_c")

    df = [F.count(F.when(F.get("_tf", F.lit(i)) > 0, 1)).cast("double") for i in range(len(terms))]
    stats = count_of(docs).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_avg"), F.array(*df).alias("_df"))
    low, one = F.lower(text_of(*resolve(docs, field))), F.lit(1)
    may = needed([reduce(or_, [F.contains(low, F.lit(w)) for w in t]) for t in terms])
    rows = count_of(docs.where(may))
    stats = stats.withColumn("_avg", F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)).withColumn("_one", one)
    return rows.withColumn("_is", one).join(F.broadcast(stats), F.col("_is") == F.col("_one")).drop("_is", "_one")


def _score(terms: list[str], params: Bm25) -> Column:
    total = F.lit(0.0)
    for i in range(len(terms)):
        total = total + params.term(F.get("_tf", F.lit(i)).cast("double"), F.get("_df", F.lit(i)), F.col("_n"), F.col("_len").cast("double"), F.col("_avg"))
    return total


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts)


_OWN = ("_len", "_tf", "_n", "_avg", "_df", "_hit")


def search(df: DataFrame, field: str, query: str, k: int | None, analyzer: Analyzer = Analyzer(), params: Bm25 = Bm25()) -> DataFrame:
    """df's k best rows with ``score`` (over 0), ties by key. Statistics are those of df, so what is filtered before doesn't count."""
    params.validate()
    docs = _corpus(df, field, analyzer, False)
    terms = list(dict.fromkeys(terms_of(df.sparkSession, analyzer, query)))
    if docs is None or not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    found = _counted(docs, field, [analyzer.forms(t) for t in terms], _any).withColumn("score", _score(terms, params)).where("score > 0").drop(*_OWN)
    found = found.orderBy(F.desc("score"), "key")
    return found if k is None else found.limit(k)


def phrase(df: DataFrame, field: str, query: str, k: int | None, analyzer: Analyzer = Analyzer(), params: Bm25 = Bm25()) -> DataFrame:
    """Rows in which the analysed phrase stands word by word, scored by all its terms, repeats included."""
    params.validate()
    docs = _corpus(df, field, analyzer, False)
    terms = terms_of(df.sparkSession, analyzer, query)
    if docs is None or not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    spelled = [analyzer.forms(t) for t in terms]

    def hit(tok: Column) -> Column:
        # Places are only looked at in texts that have the first term at all.
        stands = lambda x, i: F.when(x.isin(*spelled[0]), _all([F.coalesce(F.get(tok, i + j).isin(*w), F.lit(False)) for j, w in enumerate(spelled[1:], 1)])).otherwise(False)
        return F.when(F.arrays_overlap(tok, F.array(*map(F.lit, spelled[0]))), F.exists(F.transform(tok, stands), lambda x: x)).otherwise(False)

    found = _counted(docs, field, spelled, _all, hit).where("_hit").withColumn("score", _score(terms, params)).drop(*_OWN)
    found = found.orderBy(F.desc("score"), "key")
    return found if k is None else found.limit(k)


def postings(df: DataFrame, field: str, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """term, key, tf, len, positions: what a text index is made of."""
    docs = _corpus(df, field, analyzer)
    if docs is None:
        return df.sparkSession.createDataFrame([], "term string, key string, tf int, len int, positions array<int>")
    words = docs.select("key", F.size("_tok").alias("len"), F.posexplode("_tok").alias("pos", "term"))
    return words.groupBy("term", "key").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("len").alias("len"), F.array_sort(F.collect_list("pos")).alias("positions")).select("term", "key", "tf", "len", "positions")


def search_postings(index: DataFrame, stats: dict, terms: list[str], k: int, params: Bm25 = Bm25()) -> DataFrame:
    """key, score from postings; stats: n (texts) and average length of the whole field. Reads only the query's terms."""
    terms = list(dict.fromkeys(terms))
    mine = index.where(F.col("term").isin(*terms))
    df = mine.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    n, avg = F.lit(float(stats["n"])), F.lit(float(stats["avg"] or 1.0))
    # One row for each term of the query at most.
    scored = mine.join(F.broadcast(df), "term").withColumn("s", params.term(F.col("tf").cast("double"), F.col("df"), n, F.col("len").cast("double"), avg))
    return scored.groupBy("key").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "key").limit(k)


def phrase_postings(index: DataFrame, stats: dict, terms: list[str], k: int, params: Bm25 = Bm25()) -> DataFrame:
    """key, score of documents whose postings put the terms side by side."""
    mine = index.where(F.col("term").isin(*terms))
    moved = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)])
    starts = mine.select("key", "term", F.explode(F.filter(moved, lambda x: x.t == F.col("term"))).alias("x"), "positions")
    starts = starts.select("key", F.col("x.i").alias("i"), F.explode("positions").alias("p")).groupBy("key", (F.col("p") - F.col("i")).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    whole = starts.where(F.col("c") == len(terms)).select("key").distinct()
    repeats = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, float(terms.count(t)))])
    df = mine.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    n, avg = F.lit(float(stats["n"])), F.lit(float(stats["avg"] or 1.0))
    scored = mine.join(whole, "key").join(F.broadcast(df), "term").withColumn("s", repeats[F.col("term")] * params.term(F.col("tf").cast("double"), F.col("df"), n, F.col("len").cast("double"), avg))
    return scored.groupBy("key").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "key").limit(k)
