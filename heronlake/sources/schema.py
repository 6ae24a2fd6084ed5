"""Declared schemas, checked when rows are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import kind_of_type, resolve, variant_kind

TYPES = ("any", "bool", "int", "float", "text", "bytes", "vector", "array", "map")


@dataclass(frozen=True)
class FieldRule:
    """A dotted field: its type (an int is no float), whether it has to be there, whether its values differ."""

    name: str
    type: str = "any"
    required: bool = False
    unique: bool = False


def _wrong(at: Column, kind: T.DataType, wanted: str) -> Column:
    k = kind_of_type(kind)
    if wanted == "any":
        return F.lit(False)
    if k == "variant":
        return ~variant_kind(at).isin(wanted, "null")
    vector = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.lit(not (k == wanted and not (wanted == "array" and vector) or (wanted == "vector" and vector)))


def violations(rows: DataFrame, present: DataFrame | None, rules: list[FieldRule]) -> DataFrame:
    """key, field, problem for the rows to be written; present: rows that stay, for unique fields. Null and missing values pass type and unique checks."""
    spark, out = rows.sparkSession, None
    for rule in rules:
        at, kind = resolve(rows, rule.name)
        if at is None:
            found = rows.select("key", F.lit(rule.name).alias("field"), F.lit("required").alias("problem")) if rule.required else None
        else:
            absent = at.isNull() | (variant_kind(at) == "null") if isinstance(kind, T.VariantType) else at.isNull()
            problem = F.when(absent, F.lit("required") if rule.required else F.lit(None)).when(_wrong(at, kind, rule.type), "type")
            found = rows.select("key", F.lit(rule.name).alias("field"), problem.alias("problem")).where("problem is not null")
            if rule.unique:
                ident = lambda d: (lambda a, k: d.where(a.isNotNull()).select("key", identity(a, k).alias("v")))(*resolve(d, rule.name))
                every = ident(rows).withColumn("new", F.lit(True))
                if present is not None and resolve(present, rule.name)[0] is not None:
                    every = every.unionByName(ident(present).withColumn("new", F.lit(False)))
                twice = every.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new"), F.min("key").alias("key")).where("n > 1 and new and v is not null")
                found = found.unionByName(twice.select("key", F.lit(rule.name).alias("field"), F.lit("unique").alias("problem")))
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "key string, field string, problem string") if out is None else out


def identity(at: Column, kind: T.DataType) -> Column:
    """A value as text that equal values share: kinds differ, so an int never equals a float; NaN equals itself; null for null."""
    k = kind_of_type(kind)
    if k == "variant":
        return F.when(variant_kind(at) != "null", F.concat_ws(":", variant_kind(at), F.to_json(at)))
    if k == "float":
        at = F.when(at == 0, F.lit(0.0)).otherwise(at.cast("double"))
    return F.when(at.isNotNull(), F.concat(F.lit(k + ":"), F.to_json(F.struct(at.alias("v"))) if k in ("array", "map") else F.hex(at) if k == "bytes" else at.cast("string")))
