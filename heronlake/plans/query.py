"""The query builder: filter, rank by vectors and texts, fuse, diversify, order, cut, project; or aggregate."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.kinds import order_columns, resolve
from ..functions.text import Analyzer, Bm25
from ..functions.vectors import METRICS
from ..operators import aggregates as A
from ..operators import fusion, text, vector
from .predicates import Predicate


@dataclass(frozen=True)
class VectorSource:
    field: str
    query: tuple
    k: int
    metric: str


@dataclass(frozen=True)
class TextSource:
    field: str
    query: str
    k: int
    phrase: bool = False


@dataclass(frozen=True)
class Query:
    """An immutable query over a frame with ``key``; nothing is read before ``run`` or an aggregate, which check the arguments first.

    ``index`` may hold what a collection has: cells (InvertedLists and its assigned frame) by field.
    """

    df: DataFrame
    predicate: Predicate | None = None
    sources: tuple = ()
    rrf_k: float = fusion.RRF_K
    mmr: float | None = None
    count_: int | None = None
    skip: int = 0
    order: tuple | None = None
    fields: tuple | None = None
    approximate: bool = False
    analyzer: Analyzer = Analyzer()
    params: Bm25 = Bm25()
    index: tuple = ()

    def filter(self, p: Predicate) -> Query:
        return replace(self, predicate=p if self.predicate is None else self.predicate & p)

    def vector(self, field: str, query, k: int, metric: str = "cosine") -> Query:
        return replace(self, sources=(*self.sources, VectorSource(field, tuple(float(x) for x in query), k, metric)))

    def text(self, field: str, query: str, k: int) -> Query:
        return replace(self, sources=(*self.sources, TextSource(field, query, k)))

    def phrase(self, field: str, query: str, k: int) -> Query:
        return replace(self, sources=(*self.sources, TextSource(field, query, k, True)))

    def fuse_rrf(self, k: float) -> Query:
        return replace(self, rrf_k=float(k))

    def rerank_mmr(self, weight: float) -> Query:
        return replace(self, mmr=float(weight))

    def limit(self, n: int) -> Query:
        return replace(self, count_=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def order_by(self, field: str, descending: bool = False) -> Query:
        return replace(self, order=(field, descending))

    def select(self, *fields: str) -> Query:
        return replace(self, fields=fields)

    def approx(self) -> Query:
        return replace(self, approximate=True)

    def check(self) -> None:
        if not (math.isfinite(self.rrf_k) and self.rrf_k > 0):
            raise InvalidArgument("fusion needs a finite k over 0")
        if self.mmr is not None and not 0 <= self.mmr <= 1:
            raise InvalidArgument("the weight of MMR is from 0 to 1")
        if (self.count_ or 0) < 0 or self.skip < 0 or any(s.k < 0 for s in self.sources):
            raise InvalidArgument("limits and offsets aren't under 0")
        if any(isinstance(s, VectorSource) and s.metric not in METRICS for s in self.sources):
            raise InvalidArgument("unknown metric")
        self.params.validate()

    def matching(self) -> DataFrame:
        return self.df if self.predicate is None else self.df.where(self.predicate.condition(self.df))

    def _cells(self, s) -> tuple | None:
        usable = isinstance(s, VectorSource) and (self.approximate or self.predicate is None)
        return next((x for f, *x in self.index if f == s.field and x[0].metric == s.metric), None) if usable else None

    def _ranked(self, s) -> DataFrame:
        base = self.matching()
        if isinstance(s, TextSource):
            find = text.phrase if s.phrase else text.search
            return fusion.ranked(find(base, s.field, s.query, s.k, self.analyzer, self.params), F.desc("score"))
        cells = self._cells(s)
        if cells:  # candidates of the nearest cells, then the filter
            found = cells[0].search(cells[1], s.field, s.query, s.k)
            found = found if self.predicate is None else found.where(self.predicate.condition(found))
        else:
            found = vector.exact(base, s.field, s.query, s.k, s.metric)
        return fusion.ranked(found, "distance")

    def scored(self) -> DataFrame:
        """Rows with ``score``, before MMR, order and limits."""
        if not self.sources:
            return self.matching().withColumn("score", F.lit(0.0))
        # At most the sum of the sources' k rows.
        return self.df.join(F.broadcast(fusion.rrf([self._ranked(s) for s in self.sources], self.rrf_k)), "key")

    def run(self) -> DataFrame:
        """key, score and the document's columns, in order."""
        self.check()
        rows = self.scored()
        anchor = next((s for s in self.sources if isinstance(s, VectorSource)), None)
        if self.order:
            at, kind = resolve(rows, self.order[0])
            rows = rows.orderBy(*([] if at is None else order_columns(at, kind, self.order[1])), "key")
        elif self.mmr is not None and anchor:
            rows = self._diverse(rows, anchor)
        elif self.sources:
            rows = rows.orderBy(F.desc("score"), "key")
        else:
            rows = rows.orderBy("key")
        if self.skip:
            rows = rows.offset(self.skip)
        if self.count_ is not None:
            rows = rows.limit(self.count_)
        return rows if self.fields is None else rows.select("key", "score", *projected(rows, self.fields))

    def _diverse(self, rows: DataFrame, anchor: VectorSource) -> DataFrame:
        """Orders fused rows, of which there are at most the sum of the sources' k, on the driver; those without a usable vector come last."""
        at, _ = resolve(rows, anchor.field)
        some = rows.orderBy(F.desc("score"), "key").select("key", at.alias("v")).collect()
        usable = [r for r in some if r.v is not None and len(r.v) == len(anchor.query)]
        order = fusion.mmr(anchor.query, [r.key for r in usable], [r.v for r in usable], self.mmr, anchor.metric)
        held = set(order)
        order += [r.key for r in some if r.key not in held]
        kind = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("_place", T.LongType())])
        places = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], kind)
        return rows.join(F.broadcast(places), "key").orderBy("_place").drop("_place")

    def count(self) -> DataFrame:
        return self._agg(A.count)

    def sum(self, field: str) -> DataFrame:
        return self._agg(A.sum_of, field)

    def avg(self, field: str) -> DataFrame:
        return self._agg(A.avg_of, field)

    def min(self, field: str) -> DataFrame:
        return self._agg(A.extreme, field, False)

    def max(self, field: str) -> DataFrame:
        return self._agg(A.extreme, field, True)

    def count_distinct(self, field: str) -> DataFrame:
        return self._agg(A.count_distinct, field)

    def group_count(self, group: str) -> DataFrame:
        return self._agg(A.group_count, group)

    def group_sum(self, group: str, field: str) -> DataFrame:
        return self._agg(A.group_sum, group, field)

    def group_avg(self, group: str, field: str) -> DataFrame:
        return self._agg(A.group_avg, group, field)

    def approx_distinct(self, field: str) -> DataFrame:
        return A.approx_distinct(self.df, field)

    def _agg(self, f, *args) -> DataFrame:
        self.check()
        return f(self.matching(), *args)

    def plan_shape(self) -> str:
        """What drives the query: ann, text, streaming-topk, sort or scan."""
        if any(self._cells(s) for s in self.sources):
            return "ann"
        if self.sources:
            return "text" if isinstance(self.sources[0], TextSource) and len(self.sources) == 1 else "streaming-topk"
        return "sort" if self.order and self.predicate is None else "scan"

    def plan_key(self) -> str:
        """A canonical text of the query's shape."""
        parts = {"filter": repr(self.predicate), "sources": [repr(s) for s in self.sources], "rrf": self.rrf_k, "mmr": self.mmr, "limit": self.count_, "offset": self.skip, "order": self.order, "select": self.fields, "approx": self.approximate}
        return json.dumps(parts, sort_keys=True)

    def explain(self) -> str:
        got = self.run()
        return f"{self.plan_shape()}\n{got._jdf.queryExecution().toString()}"


def projected(df: DataFrame, fields: tuple) -> list:
    """Columns for fields, dotted paths nested again; missing ones are left out."""
    tree: dict = {}
    for path in fields:
        if resolve(df, path)[0] is not None:
            at = tree
            *way, last = path.split(".")
            for step in way:
                at = at.setdefault(step, {})
                if at is None:
                    break
            if at is not None:
                at[last] = None

    def column(prefix: str, node):
        if node is None:
            return resolve(df, prefix)[0]
        return F.struct(*[column(f"{prefix}.{k}", v).alias(k) for k, v in node.items()])

    return [column(k, v).alias(k) for k, v in tree.items() if k not in ("key", "score")]


class PlanCache:
    """Prepared queries by their canonical text."""

    def __init__(self):
        self.held: dict[str, object] = {}

    def get(self, key: str):
        return self.held.get(key)

    def insert(self, key: str, plan) -> None:
        self.held[key] = plan

    def get_or_insert_with(self, key: str, make):
        if key not in self.held:
            self.held[key] = make()
        return self.held[key]

    def __len__(self) -> int:
        return len(self.held)
