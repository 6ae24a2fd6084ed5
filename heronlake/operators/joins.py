"""Foreign-key look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import kind_of_type, resolve, variant_kind


def key_text(df: DataFrame, field: str) -> Column:
    """A field as a key: text and bytes as they are, integers in decimal; null for all else."""
    at, kind = resolve(df, field)
    if at is None:
        return F.lit(None).cast("string")
    k = kind_of_type(kind)
    if k in ("text", "int", "bytes"):
        return at.cast("string")
    if k == "variant":
        is_ = variant_kind(at)
        return F.when(is_.isin("text", "int"), F.try_variant_get(at, "$", "string")).when(is_ == "bytes", F.try_variant_get(at, "$", "binary").cast("string"))
    return F.lit(None).cast("string")


def lookup(left: DataFrame, right: DataFrame | None, field: str) -> DataFrame:
    """key, left, right: every left row and the right row whose key its field names, or null. The engine chooses how to join by size."""
    rows = left.select("key", F.struct(*left.columns).alias("left"), key_text(left, field).alias("_fk"))
    if right is None:
        return rows.select("key", "left", F.lit(None).cast("string").alias("right")).orderBy("key")
    other = right.select(F.col("key").cast("string").alias("_key"), F.struct(*right.columns).alias("right"))
    return rows.join(other, F.col("_fk") == F.col("_key"), "left").select("key", "left", "right").orderBy("key")
