"""Aggregates over a field, and by one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import group_key, kind_of_type, number_of, resolve, text_of
from ..functions.sketches import approx_distinct as hll


def _number(df: DataFrame, field: str) -> Column:
    at, kind = resolve(df, field)
    return F.lit(None).cast("double") if at is None else number_of(at, kind)


#: Kinds of native columns in which different values have different group keys, so values can be compared instead of keys.
_PLAIN = ("bool", "int", "float", "text", "time")


def _group(df: DataFrame, field: str) -> Column:
    """Something that tells groups apart: a plain column's value itself, as a key is dear to spell for each row, else the key."""
    at, kind = resolve(df, field)
    if at is None:
        return F.lit(None).cast("string")
    return at if kind_of_type(kind) in _PLAIN else group_key(at, kind)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def sum_of(df: DataFrame, field: str) -> DataFrame:
    """Sum of the numbers, 0.0 of none."""
    return df.agg(F.coalesce(F.sum(_number(df, field)), F.lit(0.0)).alias("sum"))


def avg_of(df: DataFrame, field: str) -> DataFrame:
    """Mean of the numbers, null of none."""
    return df.agg(F.avg(_number(df, field)).alias("avg"))


def extreme(df: DataFrame, field: str, greatest: bool) -> DataFrame:
    """The least or greatest number or text (column ``value``). Where a field holds both, the kind of the first row by key counts."""
    name = "max" if greatest else "min"
    pick = F.max if greatest else F.min
    at, kind = resolve(df, field)
    if at is None:
        return df.agg(F.first(F.lit(None).cast("double")).alias(name))
    k = kind_of_type(kind)
    if k in ("int", "text", "time"):
        return df.agg(pick(at).alias(name))
    number = number_of(at, kind)
    number = F.when(~F.isnan(number), number)
    if k != "variant":
        return df.agg(pick(number).alias(name))
    text = text_of(at, kind)
    first = F.min_by(F.when(number.isNotNull(), "number").otherwise("text"), F.when(number.isNotNull() | text.isNotNull(), F.col("key")))
    got = df.agg(first.alias("k"), pick(number).alias("n"), pick(text).alias("t"))
    return got.select(F.when(F.col("k") == "number", F.col("n").cast("string")).otherwise(F.col("t")).alias(name))


def count_distinct(df: DataFrame, field: str) -> DataFrame:
    return df.agg(F.count_distinct(_group(df, field)).alias("count_distinct"))


def approx_distinct(df: DataFrame, field: str, precision: int = 14) -> DataFrame:
    """Estimate over values with their kind; a null that is present counts, a missing value doesn't."""
    at, kind = resolve(df, field)
    if at is None:
        return df.agg(F.lit(0).cast("long").alias("approx_distinct"))
    if kind_of_type(kind) in ("int", "text"):
        return df.agg(F.coalesce(hll(at, precision), F.lit(0).cast("long")).alias("approx_distinct"))
    tagged = F.coalesce(group_key(at, kind), F.concat(F.lit("c:"), at.cast("string") if kind_of_type(kind) not in ("array", "map", "variant") else F.to_json(at) if kind_of_type(kind) != "array" else F.to_json(F.struct(at))))
    return df.agg(F.coalesce(hll(tagged, precision), F.lit(0).cast("long")).alias("approx_distinct"))


def _grouped(df: DataFrame, group: str, number: Column | None) -> DataFrame:
    """group, n, total. Rows are first summed by the plain value, so that its key is spelled once for each value and not for each row."""
    at, kind = resolve(df, group)
    if at is None:
        return df.sparkSession.createDataFrame([], "group string, n long, total double")
    rows = df.select(at.alias("_v"), (F.lit(0.0) if number is None else number).alias("_x")).where("_x is not null")
    if kind_of_type(kind) in _PLAIN:
        # Nulls go here: a test of the key would be pushed below the first sum and spell it for each row after all.
        sums = rows.where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("total")).select(group_key(F.col("_v"), kind).alias("group"), "n", "total")
    else:
        sums = rows.select(group_key(F.col("_v"), kind).alias("group"), F.lit(1).alias("n"), F.col("_x").alias("total")).where("group is not null")
    return sums.groupBy("group").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("group")


def group_count(df: DataFrame, group: str) -> DataFrame:
    return _grouped(df, group, None).select("group", F.col("n").alias("count"))


def group_sum(df: DataFrame, group: str, field: str) -> DataFrame:
    """Groups need a key and a number in a row."""
    return _grouped(df, group, _number(df, field)).select("group", F.col("total").alias("sum"))


def group_avg(df: DataFrame, group: str, field: str) -> DataFrame:
    return _grouped(df, group, _number(df, field)).select("group", (F.col("total") / F.col("n")).alias("avg"))
