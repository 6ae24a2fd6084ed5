"""Python documents to frames and back: a column for each field, VARIANT where documents differ in kind."""

from __future__ import annotations

import base64
import json
import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import kind_of_value


class Vector(list):
    """An embedding: floats in single precision, a kind of its own."""


def type_of(v) -> T.DataType | None:
    """Spark type of a value; None for null, VARIANT where elements differ."""
    if isinstance(v, Vector):
        return T.ArrayType(T.FloatType())
    kind = kind_of_value(v)
    simple = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bytes": T.BinaryType(), "time": T.TimestampType(), "null": None}
    if kind in simple:
        return simple[kind]
    if kind == "array":
        inner = common([type_of(x) for x in v])
        return T.ArrayType(inner or T.StringType())
    return T.StructType([T.StructField(k, type_of(x) or T.StringType()) for k, x in sorted(v.items())]) if v else T.MapType(T.StringType(), T.StringType())


def common(types: list) -> T.DataType | None:
    found = []
    for t in types:
        if t is not None and t not in found:
            found.append(t)
    if len(found) < 2:
        return found[0] if found else None
    if all(isinstance(t, T.StructType) for t in found):
        names = sorted({n for t in found for n in t.names})
        return T.StructType([T.StructField(n, common([t[n].dataType for t in found if n in t.names])) for n in names])
    return T.VariantType()


def has_variant(t: T.DataType) -> bool:
    return isinstance(t, T.VariantType) or (isinstance(t, T.ArrayType) and has_variant(t.elementType)) or (isinstance(t, T.StructType) and any(has_variant(f.dataType) for f in t.fields))


def plain(v):
    """JSON form: bytes as {"$bytes": ..}, vectors as arrays, numbers that aren't finite as null."""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return {"$bytes": list(v)}
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v if isinstance(v, (bool, int, float, str, type(None))) else str(v)


def native(v):
    """A value as Spark takes it."""
    if isinstance(v, Vector):
        return [float(x) for x in v]
    if isinstance(v, dict):
        return {k: native(x) for k, x in v.items()}
    return [native(x) for x in v] if isinstance(v, (list, tuple)) else v


def shown(v):
    """A cell of a row as a document's value."""
    if isinstance(v, T.VariantVal):
        return v.toPython()
    if isinstance(v, Row):
        return {k: shown(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, dict):
        return {k: shown(x) for k, x in v.items()}
    if isinstance(v, list):
        return [shown(x) for x in v]
    return bytes(v) if isinstance(v, bytearray) else v


def frame(spark: SparkSession, rows: list[tuple[str, dict]]) -> DataFrame:
    """key and a column for each field of the documents."""
    names = sorted({k for _, d in rows for k in d})
    types = {n: common([type_of(d[n]) for _, d in rows if n in d]) or T.StringType() for n in names}
    mixed = {n for n, t in types.items() if has_variant(t)}
    schema = T.StructType([T.StructField("key", T.StringType(), False), *[T.StructField(n, T.StringType() if n in mixed else types[n]) for n in names]])

    def cell(n, d):
        if n not in d:
            return None
        return json.dumps(plain(d[n])) if n in mixed else native(d[n])

    out = spark.createDataFrame([(k, *[cell(n, d) for n in names]) for k, d in rows], schema)
    return out.withColumns({n: F.parse_json(F.col(f"`{n}`")) for n in mixed}) if mixed else out


def as_variant(df: DataFrame, name: str) -> DataFrame:
    t = df.schema[name].dataType
    if isinstance(t, T.VariantType):
        return df
    c = F.col(f"`{name}`")
    return df.withColumn(name, F.when(c.isNotNull(), F.to_variant_object(c)) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else c.cast("variant"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns that one hasn't are missing there, columns that differ in type become VARIANT."""
    for n in set(a.columns) & set(b.columns):
        if n != "key" and a.schema[n].dataType != b.schema[n].dataType:
            a, b = as_variant(a, n), as_variant(b, n)
    return a.unionByName(b, allowMissingColumns=True)


def from_wire(v):
    """JSON values with {"$vector": [..]} and {"$bytes": [..]} for what JSON hasn't."""
    if isinstance(v, dict):
        if set(v) == {"$vector"} and isinstance(v["$vector"], list) and all(isinstance(x, (int, float)) for x in v["$vector"]):
            return Vector(float(x) for x in v["$vector"])
        if set(v) == {"$bytes"} and isinstance(v["$bytes"], list) and all(isinstance(x, int) and 0 <= x < 256 for x in v["$bytes"]):
            return bytes(v["$bytes"])
        return {k: from_wire(x) for k, x in v.items()}
    if isinstance(v, list):
        return [from_wire(x) for x in v]
    return v


def to_base64(v: bytes) -> str:
    return base64.b64encode(v).decode()
