"""Kinds of values: what a column, a VARIANT cell or a Python value is to predicates, grouping and ordering.

Kinds: bool, int, float, text, bytes, array, map, time, variant, null. A native column's null is a missing value; a VARIANT
column can also hold a null that is present.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("int", "float")


def let(value: Column, body) -> Column:
    """body(value), with value computed once. An expression that only stands within a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "map"
    if isinstance(t, T.VariantType):
        return "variant"
    return "null"


def kind_of_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "text"
    if isinstance(v, (bytes, bytearray)):
        return "bytes"
    if isinstance(v, (dt.datetime, dt.date)):
        return "time"
    if isinstance(v, (list, tuple)):
        return "array"
    if isinstance(v, dict):
        return "map"
    raise TypeError(f"no kind for {type(v).__name__}")


def is_nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


def resolve(df: DataFrame, path: str) -> tuple[Column | None, T.DataType | None]:
    """Column and type at a dotted path of a frame; (None, None) if there is none. Within VARIANT the rest of the path is looked up in the value."""
    if not path:
        return None, None
    steps = path.split(".")
    if steps[0] not in df.columns:
        return None, None
    at, kind = F.col(f"`{steps[0]}`"), df.schema[steps[0]].dataType
    for k, step in enumerate(steps[1:], 1):
        if isinstance(kind, T.VariantType):
            rest = "$" + "".join(f"['{s}']" for s in steps[k:])
            return F.try_variant_get(at, rest, "variant"), kind
        if isinstance(kind, T.StructType) and step in kind.names:
            at, kind = at.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            at, kind = F.try_element_at(at, F.lit(step)), kind.valueType
        else:
            return None, None
    return at, kind


def variant_kind(v: Column) -> Column:
    """Kind of a VARIANT cell, null where it is missing. Decimals, which parsing makes of numbers with a point, count as floats."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "int")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
        .when(s == "STRING", "text")
        .when(s == "BINARY", "bytes")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("map")
    )


def number_of(at: Column, kind: T.DataType) -> Column:
    """The value as a double where it is a number, else null."""
    k = kind_of_type(kind)
    if k in NUMBERS:
        return at.cast("double")
    if k == "variant":
        return F.when(variant_kind(at).isin(*NUMBERS), F.try_variant_get(at, "$", "double"))
    return F.lit(None).cast("double")


def text_of(at: Column, kind: T.DataType) -> Column:
    k = kind_of_type(kind)
    if k == "text":
        return at
    if k == "variant":
        return F.when(variant_kind(at) == "text", F.try_variant_get(at, "$", "string"))
    return F.lit(None).cast("string")


def plain_number(x: Column) -> Column:
    """A double in the shortest digits that tell it apart, without an exponent or a point that isn't needed: 1, 2.5, NaN, inf."""
    x = F.when(x == 0, F.lit(0.0)).otherwise(x)
    shown = x.cast("string")
    mantissa, power = F.split_part(shown, F.lit("E"), F.lit(1)), F.split_part(shown, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    whole = F.replace(F.split_part(mantissa, F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    part = F.split_part(mantissa, F.lit("."), F.lit(2))
    digits, place = F.concat(whole, part), F.length(whole) + F.coalesce(power, F.lit(0))
    left = F.when(place <= 0, "0").otherwise(F.rpad(F.substring(digits, F.lit(1), place), place, "0"))
    right = F.when(place <= 0, F.concat(F.repeat(F.lit("0"), -place), digits)).otherwise(F.substring(digits, place + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    usual = F.concat(sign, left, F.when(right != "", F.concat(F.lit("."), right)).otherwise(""))
    return F.when(F.isnan(x), "NaN").when(shown == "Infinity", "inf").when(shown == "-Infinity", "-inf").otherwise(usual)


def group_key(at: Column, kind: T.DataType) -> Column:
    """Canonical key of a value for grouping, null where it has none (missing, null, containers, bytes).

    Text stands for itself, other kinds carry a tag (i: f: b:), and text that begins like a tag is marked with t:.
    """

    def text(x: Column) -> Column:
        return F.when(x.rlike("^[ifbt]:"), F.concat(F.lit("t:"), x)).otherwise(x)

    k = kind_of_type(kind)
    if k == "text":
        return text(at)
    if k == "int":
        return F.concat(F.lit("i:"), at.cast("string"))
    if k == "float":
        return F.concat(F.lit("f:"), plain_number(at.cast("double")))
    if k == "bool":
        return F.concat(F.lit("b:"), at.cast("string"))
    if k == "time":
        return F.concat(F.lit("i:"), F.unix_micros(at.cast("timestamp")).cast("string"))
    if k == "variant":
        is_ = variant_kind(at)
        return (
            F.when(is_ == "text", text(F.try_variant_get(at, "$", "string")))
            .when(is_ == "int", F.concat(F.lit("i:"), F.try_variant_get(at, "$", "bigint").cast("string")))
            .when(is_ == "float", F.concat(F.lit("f:"), plain_number(F.try_variant_get(at, "$", "double"))))
            .when(is_ == "bool", F.concat(F.lit("b:"), F.try_variant_get(at, "$", "boolean").cast("string")))
        )
    return F.lit(None).cast("string")


def order_columns(at: Column, kind: T.DataType, descending: bool) -> list[Column]:
    """Sort columns for a field: comparable values (numbers, then text), then values without an order (NaN, bool, bytes, containers, null), then missing ones; descending turns round only within the comparable."""
    k = kind_of_type(kind)
    number, text = number_of(at, kind), text_of(at, kind)
    if k == "time":
        number = F.unix_micros(at.cast("timestamp")).cast("double")
    if k == "variant":
        number = F.when(F.isnan(number), None).otherwise(number)
        cls = F.when(at.isNull(), 2).when(number.isNotNull() | text.isNotNull(), 0).otherwise(1)
        sub = F.when(text.isNotNull(), 1).otherwise(0)
    else:
        ordered = k in ("int", "float", "text", "time")
        nan = F.coalesce(F.isnan(number), F.lit(False)) if k == "float" else F.lit(False)
        cls = F.when(at.isNull(), 2).when(F.lit(not ordered) | nan, 1).otherwise(0)
        sub = None
        number = F.when(nan, None).otherwise(at if k == "int" else number)
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    out = [cls.asc()]
    if sub is not None:
        out.append(turn(sub))
    if k in ("int", "float", "time", "variant"):
        out.append(turn(number))
    if k in ("text", "variant"):
        out.append(turn(text))
    return out
