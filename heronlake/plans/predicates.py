"""Predicates with two values: what is missing or of another kind makes a comparison false, and ``not`` turns that to true.

A predicate is compiled to a column for one frame, by the kinds of its columns. Under ``where`` a comparison's null counts as
false anyway, so comparisons stay as they are and reach the files; below a ``not`` each one is made two-valued first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.geo import within
from ..functions.kinds import NUMBERS, is_nan, kind_of_type, kind_of_value, number_of, resolve, text_of, variant_kind



class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def condition(self, df: DataFrame) -> Column:
        """For ``where``."""
        return self._column(df, False)

    def truth(self, df: DataFrame) -> Column:
        """True or false, never null."""
        return F.coalesce(self._column(df, True), F.lit(False))

    def _column(self, df: DataFrame, total: bool) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def _column(self, df, total):
        return self.left._column(df, total) & self.right._column(df, total)


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def _column(self, df, total):
        return self.left._column(df, total) | self.right._column(df, total)


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def _column(self, df, total):
        return ~self.inner._column(df, True)


@dataclass(frozen=True)
class Leaf(Predicate):
    path: str

    def _column(self, df, total):
        at, kind = resolve(df, self.path)
        if at is None:
            return F.lit(False)
        out = self._leaf(df, at, kind)
        return F.coalesce(out, F.lit(False)) if total else out

    def _leaf(self, df: DataFrame, at: Column, kind: T.DataType) -> Column:
        raise NotImplementedError


def _time(at: Column, v) -> tuple[Column, Column]:
    """Both sides as microseconds since 1970 if v is a number, else as timestamps."""
    if kind_of_value(v) == "int":
        return F.unix_micros(at.cast("timestamp")), F.lit(v)
    return at, F.lit(v)


def equal(at: Column, kind: T.DataType, v) -> Column:
    """Whether present values equal v: numbers by value, others only within their kind; NaN equals nothing."""
    k, w = kind_of_type(kind), kind_of_value(v)
    if is_nan(v):
        return F.lit(False)
    if k == "variant":
        is_ = variant_kind(at)
        if w == "null":
            return is_ == "null"
        if w in NUMBERS:
            exact = F.try_variant_get(at, "$", "bigint") == F.lit(v) if w == "int" else None
            near = number_of(at, kind) == F.lit(float(v))
            return F.when(is_ == "int", exact).otherwise(near) if w == "int" else near
        if w == "text":
            return text_of(at, kind) == F.lit(v)
        if w == "bool":
            return (is_ == "bool") & (F.try_variant_get(at, "$", "boolean") == F.lit(v))
        if w == "bytes":
            return (is_ == "bytes") & (F.try_variant_get(at, "$", "binary") == F.lit(bytes(v)))
        import json

        return (is_ == w) & (F.to_json(at) == F.to_json(F.parse_json(F.lit(json.dumps(v)))))
    if w == "null" or k == "null":
        return F.lit(False)
    if k in NUMBERS and w in NUMBERS:
        if k == "int" and w == "int":
            return at == F.lit(v) if -(1 << 63) <= v < 1 << 63 else F.lit(False)
        if k == "int" and float(v).is_integer() and abs(v) < 1 << 53:
            return at == F.lit(int(v))
        return at.cast("double") == F.lit(float(v))
    if k == "time" and w in ("time", "int"):
        a, b = _time(at, v)
        return a == b
    if k != w:
        return F.lit(False)
    if k == "array":
        return at == F.lit(list(v)).cast(kind) if v else F.size(at) == 0
    if k == "map":
        same = F.lit(True)
        if isinstance(kind, T.StructType):
            if set(v) - set(kind.names):
                return F.lit(False)
            for f in kind.fields:
                part = at.getField(f.name)
                same = same & (F.coalesce(equal(part, f.dataType, v[f.name]), F.lit(False)) if f.name in v else part.isNull())
            return at.isNotNull() & same
        for name, x in v.items():
            same = same & F.coalesce(equal(F.try_element_at(at, F.lit(name)), kind.valueType, x), F.lit(False))
        return (F.size(F.map_keys(at)) == len(v)) & same
    return at == F.lit(bytes(v) if k == "bytes" else v)


def ordered(at: Column, kind: T.DataType, op: str, v) -> Column:
    """lt, le, gt, ge: numbers with numbers, text with text (by bytes), times; all else is false, as is NaN."""
    k, w = kind_of_type(kind), kind_of_value(v)
    if is_nan(v):
        return F.lit(False)
    if k == "variant":
        side = number_of(at, kind) if w in NUMBERS else text_of(at, kind) if w == "text" else None
    elif k in NUMBERS and w in NUMBERS:
        side = at if k == w == "int" and -(1 << 63) <= v < 1 << 63 else at.cast("double")
    elif k == "time" and w in ("time", "int"):
        side = _time(at, v)[0]
    else:
        side = at if k == w == "text" else None
    if side is None:
        return F.lit(False)
    lit = F.lit(float(v)) if w in NUMBERS and not (k == w == "int") and k != "time" else F.lit(v)
    out = {"lt": side < lit, "le": side <= lit, "gt": side > lit, "ge": side >= lit}[op]
    return out & ~F.isnan(side) if k in ("float", "variant") and w in NUMBERS else out


@dataclass(frozen=True)
class Compare(Leaf):
    op: str
    value: object

    def _leaf(self, df, at, kind):
        if self.op == "eq":
            return equal(at, kind, self.value)
        if self.op == "ne":
            return at.isNotNull() & ~F.coalesce(equal(at, kind, self.value), F.lit(False))
        return ordered(at, kind, self.op, self.value)


@dataclass(frozen=True)
class Exists(Leaf):
    def _leaf(self, df, at, kind):
        return at.isNotNull()


@dataclass(frozen=True)
class In(Leaf):
    values: tuple

    def _leaf(self, df, at, kind):
        k = kind_of_type(kind)
        simple = [v for v in self.values if kind_of_value(v) == k and k in ("int", "text", "bool")]
        out = at.isin(*simple) if simple else F.lit(False)
        for v in self.values:
            if v not in simple or kind_of_value(v) != k:
                out = out | F.coalesce(equal(at, kind, v), F.lit(False))
        return out


@dataclass(frozen=True)
class Between(Leaf):
    low: object
    high: object

    def _leaf(self, df, at, kind):
        return ordered(at, kind, "ge", self.low) & ordered(at, kind, "le", self.high)


@dataclass(frozen=True)
class TextMatch(Leaf):
    how: str
    value: str

    def _leaf(self, df, at, kind):
        text = text_of(at, kind)
        return text.startswith(self.value) if self.how == "starts_with" else text.contains(self.value)


@dataclass(frozen=True)
class WithinKm(Leaf):
    lat: float
    lon: float
    km: float

    def _leaf(self, df, at, kind):
        return within(df, self.path, self.lat, self.lon, self.km)


@dataclass(frozen=True)
class Field:
    """field("a.b").eq(1) and so on."""

    path: str

    def eq(self, v) -> Predicate:
        return Compare(self.path, "eq", v)

    def ne(self, v) -> Predicate:
        return Compare(self.path, "ne", v)

    def lt(self, v) -> Predicate:
        return Compare(self.path, "lt", v)

    def le(self, v) -> Predicate:
        return Compare(self.path, "le", v)

    def gt(self, v) -> Predicate:
        return Compare(self.path, "gt", v)

    def ge(self, v) -> Predicate:
        return Compare(self.path, "ge", v)

    def exists(self) -> Predicate:
        return Exists(self.path)

    def is_in(self, values) -> Predicate:
        return In(self.path, tuple(values))

    def between(self, low, high) -> Predicate:
        return Between(self.path, low, high)

    def starts_with(self, prefix: str) -> Predicate:
        return TextMatch(self.path, "starts_with", prefix)

    def contains(self, part: str) -> Predicate:
        return TextMatch(self.path, "contains", part)

    def within_km(self, lat: float, lon: float, km: float) -> Predicate:
        return WithinKm(self.path, float(lat), float(lon), float(km))


def field(path: str) -> Field:
    return Field(path)


def from_json(tree: dict) -> Predicate:
    """A predicate from its JSON form: {"op": "and" | "or", "clauses": [..]}, {"op": "not", "clause": ..}, or a leaf with op and field."""
    if not isinstance(tree, dict) or "op" not in tree:
        raise InvalidArgument("a filter is an object with an op")
    op = tree["op"]

    def need(name: str, kind: type | tuple = object):
        if name not in tree or not isinstance(tree[name], kind):
            raise InvalidArgument(f"filter {op} needs {name}")
        return tree[name]

    if op in ("and", "or"):
        parts = [from_json(x) for x in need("clauses", list)]
        if not parts:
            raise InvalidArgument(f"filter {op} needs a clause at least")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        return ~from_json(need("clause", dict))
    leaf = field(need("field", str)) if op in {"exists", "geo_within", "in", "between", "starts_with", "contains", "eq", "ne", "lt", "le", "gt", "ge"} else None
    if leaf is None:
        raise InvalidArgument(f"unknown filter op: {op}")
    if op == "exists":
        return leaf.exists()
    if op == "geo_within":
        return leaf.within_km(*[float(need(x, (int, float))) for x in ("lat", "lon", "radius_km")])
    if op == "in":
        return leaf.is_in(need("values", list))
    if op == "between":
        return leaf.between(need("low"), need("high"))
    if op in ("starts_with", "contains"):
        return getattr(leaf, op)(need("value", str))
    return getattr(leaf, op)(need("value"))
