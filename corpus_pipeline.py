"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import decontam, lang_id, ngram_join, packing, pii
from heronlake.llm.common import cleared, cut, scratch, table, without
from heronlake.llm.tokens import vocabulary

#: A document goes if the best language has less than this of the probability.
LEAST_SCORE = 0.4


def _key(docs: DataFrame):
    """Tells rows apart by id and text, so that null and repeated ids do no harm."""
    return F.xxhash64("doc_id", "text")


def _less(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows of these keys (column doc_id), whatever else docs has for columns."""
    rows = docs.select(_key(docs).alias("doc_id"), F.struct("*").alias("row"))
    return without(rows, keys).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose best language has less than LEAST_SCORE.

    The network learns from the documents' own labels; where there are none, only texts without a letter go. Equal rows are
    kept or dropped together; no rows give no rows.
    """
    lettered = docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    found = lang_id.predict(lettered.select(_key(docs).alias("doc_id"), "text"), lang_id.train(*lang_id.sample(docs)))
    return _less(lettered, found.where((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") < LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links at a similarity of 0.75 over five-word shingles: that of the least id (null last).

    Of rows equal in id and text one stays; rows of one id with different texts are documents of their own. Null and empty
    texts are linked with nothing and stay, one for each id. No rows give no rows.
    """
    keys = docs.select(_key(docs).alias("doc_id"), F.col("doc_id").alias("id"), "text")
    found = cut(ngram_join.similar(keys, 5, 75).distinct())
    own = keys.groupBy("doc_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    own = cut(own)
    linked = found.where("component_id <> doc_id").select("component_id").distinct()
    members = cut(found.join(linked, "component_id", "left_semi").join(own, "doc_id"))
    stay = members.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.col("id").isNull(), "id", "doc_id")).alias("stay"))
    kept = _less(docs, members.join(stay, "component_id").where("doc_id <> stay"))
    again = own.where("rows > 1")
    if again.limit(1).count():
        rows = kept.select(_key(docs).alias("doc_id"), F.struct("*").alias("row"))
        kept = _less(kept, again).unionByName(rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("row.*"))
    return kept


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of the benchmark, however small its share of the document.

    A window is 13 words in a row of an item, or all words of a shorter one. Null and empty texts hold none and stay; equal
    rows go together; an empty benchmark drops nothing; no rows give no rows.
    """
    keys = docs.select(_key(docs).alias("doc_id"), "text")
    return _less(docs, decontam.contaminated(keys, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that reveal it, in the texts; every row stays, null and empty texts as they are. No rows give no rows."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of sequences of 4096 tokens.

    Null and empty texts have the end id alone; repeated rows are pieces of their own; no rows give no rows.
    """
    return packing.pack(docs, vocabulary(), 4096)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]
#: SQL can't express the trained network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; tables that a stage needs for itself are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
