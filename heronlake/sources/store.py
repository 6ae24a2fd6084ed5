"""Collections as versioned Parquet under a manifest, with mutations, schemas, expiry, edges, change feed, dump and backup.

A commit writes its rows to a new folder and then a manifest of the next number; a manifest name that is taken fails, so one
writer wins. Readers keep the version they began with. ``compact`` removes what no manifest needs.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleFormat, InvalidArgument, InvalidDump, InvalidName, ReservedCollection, SchemaViolation, StorageError
from ..functions.geo import cells
from ..functions.text import Analyzer
from ..operators import graph, joins, text, vector
from ..plans.predicates import Predicate
from ..plans.query import Query
from . import documents as D
from .files import Files
from .schema import FieldRule, violations

FORMAT = 1
CHANGES = "collection string, key string, kind string, version int"


def check_name(name: str) -> str:
    if name.startswith("__"):
        raise ReservedCollection(name)
    if not name or "__" in name or "\0" in name or "/" in name:
        raise InvalidName(name)
    return name


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root, self.listeners = root.rstrip("/"), {}
        self.manifest = {"format": FORMAT, "version": 0, "collections": {}, "edges": {}}
        found = [x for x in self.files.list("_manifests") if x.endswith(".json")]
        if found:
            self.manifest = json.loads(self.files.read(f"_manifests/{found[-1]}"))
            if self.manifest["format"] != FORMAT:
                raise IncompatibleFormat(f"format {self.manifest['format']}")

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    def collections(self) -> list[str]:
        return sorted(self.manifest["collections"])

    def write(self, df: DataFrame) -> str:
        """Rows in a new folder; its name."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return name

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{name}")

    def commit(self, change: Callable[[dict], None], events: DataFrame | None = None) -> None:
        """events: collection, key, kind of what changed. They are written aside, named by the manifest, and published once that stands."""
        self._publish()
        new = json.loads(json.dumps(self.manifest))
        change(new)
        new["version"] += 1
        new["events"] = None
        if events is not None:
            new["events"] = f"staged/{uuid.uuid4().hex}"
            events.withColumn("version", F.lit(new["version"])).write.parquet(f"{self.root}/{new['events']}")
        try:
            self.files.create(f"_manifests/{new['version']:012d}.json", json.dumps(new))
        except StorageError:
            if new["events"]:
                self.files.delete(new["events"])
            raise
        self.manifest = new
        self._publish()
        if events is not None and self.listeners:
            told = self.spark.read.schema(CHANGES).parquet(f"{self.root}/changes/{new['version']:012d}")
            for r in told.orderBy("kind", "key").toLocalIterator():
                for f in list(self.listeners.values()):
                    f(r.collection, r.key, r.kind)

    def _publish(self) -> None:
        """Moves the last commit's events to the change feed; its writer may have stopped before it could."""
        if self.manifest.get("events"):
            self.files.move(self.manifest["events"], f"changes/{self.manifest['version']:012d}")

    def subscribe(self, f: Callable[[str, str, str], None]) -> str:
        self.listeners[name := uuid.uuid4().hex] = f
        return name

    def unsubscribe(self, name: str) -> bool:
        return self.listeners.pop(name, None) is not None

    def changes(self) -> DataFrame:
        """collection, key, kind, version of all committed changes."""
        self._publish()
        if not self.files.exists("changes"):
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{self.root}/changes").where(F.col("version") <= self.manifest["version"])

    def compact(self) -> None:
        used = {x for c in self.manifest["collections"].values() for x in (c["path"], c.get("ttl"), *[i.get("path") for i in c["indexes"].values()]) if x} | {e["path"] for e in self.manifest["edges"].values()}
        for x in self.files.list("data"):
            if f"data/{x}" not in used:
                self.files.delete(f"data/{x}")
        self._publish()
        for x in self.files.list("staged"):
            self.files.delete(f"staged/{x}")
        for x in self.files.list("_manifests")[:-1]:
            self.files.delete(f"_manifests/{x}")

    def backup(self, target: str) -> None:
        self.files.copy_all(target)

    def dump(self, target: str) -> None:
        """A logical copy of one version: rows of collections, expiries and edges as Parquet, the rest as a line of text."""
        out = Files(self.spark, target)
        if out.exists("dump.json"):
            raise InvalidDump(f"{target} holds a dump")
        for name, c in self.manifest["collections"].items():
            self.read(c["path"], c["schema"]).write.parquet(f"{target}/rows/{name}")
            if c.get("ttl"):
                self.spark.read.parquet(f"{self.root}/{c['ttl']}").write.parquet(f"{target}/ttl/{name}")
        for name, e in self.manifest["edges"].items():
            self.spark.read.parquet(f"{self.root}/{e['path']}").write.parquet(f"{target}/edges/{name}")
        out.create("dump.json", json.dumps({"dump": 1, "manifest": self.manifest}))

    def load(self, source: str, renames: dict[str, str] | None = None) -> None:
        """Merges a dump in: equal keys are overwritten. Renames map collections' names; two onto one, or onto an existing one, is an error."""
        files, renames = Files(self.spark, source), renames or {}
        for to in renames.values():
            check_name(to)
        try:
            held = json.loads(files.read("dump.json"))["manifest"]
        except Exception as e:
            raise InvalidDump(source) from e
        to = {n: renames.get(n, n) for n in {*held["collections"], *held["edges"]}}
        if len(set(to.values())) < len(to) or any(renames.get(n) in self.manifest["collections"] for n in to if n in renames):
            raise InvalidArgument("two collections would have one name")
        for name, c in held["collections"].items():
            mine = self.collection(to[name])
            rows = self.spark.read.schema(T.StructType.fromJson(json.loads(c["schema"]))).parquet(f"{source}/rows/{name}")
            mine.put(rows, check=False)
            if c.get("ttl"):
                mine._ttl_put(self.spark.read.parquet(f"{source}/ttl/{name}"))
            self.commit(lambda m, n=to[name], c=c: m["collections"][n].update({"rules": c["rules"], "auto": max(c["auto"], m["collections"][n]["auto"]), "indexes": {k: v | {"path": None, "version": -1} for k, v in c["indexes"].items()}}))
        for name in held["edges"]:
            mine = self.collection(to[name])
            mine._edges_put(self.spark.read.schema(graph.EDGES).parquet(f"{source}/edges/{name}"))


class Collection:
    """A named set of (key, document), made when it is first written."""

    def __init__(self, db: Database, name: str):
        self.db, self.name, self.spark = db, name, db.spark

    @property
    def meta(self) -> dict | None:
        return self.db.manifest["collections"].get(self.name)

    def frame(self) -> DataFrame:
        """All documents: key and a column for each field."""
        if not self.meta:
            return self.spark.createDataFrame([], "key string")
        return self.db.read(self.meta["path"], self.meta["schema"])

    # reading

    def scan(self) -> DataFrame:
        return self.frame().orderBy("key")

    def for_each_doc(self, f: Callable[[str, dict], bool | None]) -> None:
        """Documents in key order, one partition at a time on the driver; ends when f returns False."""
        for r in self.scan().toLocalIterator():
            if f(r.key, self._doc(r)) is False:
                return

    @staticmethod
    def _doc(row) -> dict:
        return {k: D.shown(v) for k, v in row.asDict().items() if k != "key" and v is not None}

    def get(self, key: str) -> dict | None:
        row = self.frame().where(F.col("key") == key).first()
        return None if row is None else self._doc(row)

    def __len__(self) -> int:
        return self.meta["rows"] if self.meta else 0

    def is_empty(self) -> bool:
        return len(self) == 0

    def page(self, after: str | None, limit: int, where: Predicate | None = None) -> tuple[DataFrame, str | None]:
        """Up to ``limit`` documents with keys over ``after``, and the last key if the page is full."""
        df = self.frame()
        if after is not None:
            df = df.where(F.col("key") > after)
        if where is not None:
            df = df.where(where.condition(df))
        rows = df.orderBy("key").limit(limit)
        if limit == 0:
            return rows, None
        last = rows.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("k")).first()
        return rows, last.k if last.n == limit else None

    def page_where(self, after: str | None, limit: int, where: Predicate) -> tuple[DataFrame, str | None]:
        return self.page(after, limit, where)

    def prefix(self, start: str) -> DataFrame:
        return self.frame().where(F.col("key").startswith(start)).orderBy("key")

    def query(self) -> Query:
        index = tuple((i["field"], *self._cells(n)) for n, i in (self.meta or {"indexes": {}})["indexes"].items() if i["kind"] == "vector")
        return Query(self.frame(), index=index)

    def join(self, other: str, field: str) -> DataFrame:
        right = self.db.collection(other)
        return joins.lookup(self.frame(), right.frame() if right.meta else None, field)

    # writing

    def put(self, rows: DataFrame, check: bool = True, keep_ttl: bool = False, expiries: DataFrame | None = None, **meta) -> None:
        """Adds or overwrites rows (key and columns); of rows with one key the one that was given last stays, where ``_order`` says so, else any.

        All or nothing, with the rows' expiries (key, expires_at) and other values of the collection's manifest in the same commit.
        """
        check_name(self.name)
        if "_order" in rows.columns:
            rows = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("key", "_order")]), "_order").alias("_d")).select("key", "_d.*") if len(rows.columns) > 2 else rows.select("key").distinct()
        old = self.frame()
        stay = old.join(rows.select("key"), "key", "left_anti")
        if check and self.meta and self.meta["rules"]:
            bad = violations(rows, stay, [FieldRule(*r) for r in self.meta["rules"]]).limit(1).collect()
            if bad:
                raise SchemaViolation(f"{bad[0].field}: {bad[0].problem} ({bad[0].key})")
        ttl = None if keep_ttl or not (self.meta and self.meta.get("ttl")) else self._ttl().join(rows.select("key"), "key", "left_anti")
        if expiries is not None:
            ttl = self._ttl().join(expiries.select("key"), "key", "left_anti").unionByName(expiries)
        self._replace(D.union(stay, rows) if self.meta else rows, rows.select("key"), "insert", ttl, **meta)

    def _replace(self, rows: DataFrame, keys: DataFrame, kind: str, ttl: DataFrame | None = None, **meta) -> None:
        path = self.db.write(rows)
        back = self.spark.read.schema(rows.schema).parquet(f"{self.db.root}/{path}")
        n, ttl_path = back.count(), None if ttl is None else self.db.write(ttl)
        old = self.meta or {"rules": [], "auto": 0, "indexes": {}, "ttl": None}
        new = old | {"path": path, "schema": rows.schema.json(), "rows": n, "written": old.get("written", 0) + 1} | meta
        if ttl_path:
            new["ttl"] = ttl_path
        events = keys.select(F.lit(self.name).alias("collection"), F.col("key").cast("string").alias("key"), F.lit(kind).alias("kind"))
        self.db.commit(lambda m: m["collections"].__setitem__(self.name, new), events)

    def insert(self, key: str, doc: dict) -> None:
        self.insert_batch([(key, doc)])

    def insert_batch(self, rows: list[tuple[str, dict]]) -> None:
        last = dict(rows)
        self.put(D.frame(self.spark, sorted(last.items())))

    def insert_auto(self, doc: dict) -> str:
        """Under the next number as 20 digits; a failed insert uses none up."""
        n = (self.meta["auto"] if self.meta else 0) + 1
        self.put(D.frame(self.spark, [(key := f"{n:020d}", doc)]), auto=n)
        return key

    def update(self, key: str, f: Callable[[dict | None], dict | None]) -> None:
        new = f(self.get(key))
        self.delete(key) if new is None else self.insert(key, new)

    def patch(self, key: str, part: dict) -> None:
        self.update(key, lambda d: (d or {}) | part)

    def compare_and_set(self, key: str, expected: dict | None, new: dict | None) -> bool:
        """Only if the document is as expected (None: absent) in the version at hand; another's commit in between is an error."""
        now = self.get(key)
        if not same(now, expected):
            return False
        self.delete(key) if new is None else self.insert(key, new)
        return True

    def delete(self, key: str) -> bool:
        return self.delete_batch([key]) == 1

    def delete_batch(self, keys: list[str]) -> int:
        return self._delete(self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string"))

    def delete_where(self, where: Predicate) -> int:
        df = self.frame()
        return self._delete(df.where(where.condition(df)).select("key"))

    def _delete(self, keys: DataFrame) -> int:
        """Rows, expiries and edges of the keys, in one commit each for edges and rows; the number of documents."""
        if self.name in self.db.manifest["edges"]:
            self._edges_replace(graph.without_key(self.edges(), keys))
        if not self.meta:
            return 0
        gone = self.frame().join(keys, "key", "left_semi").select("key")
        before = len(self)
        ttl = self._ttl().join(keys, "key", "left_anti") if self.meta.get("ttl") else None
        self._replace(self.frame().join(keys, "key", "left_anti"), gone, "delete", ttl)
        return before - len(self)

    def set_schema(self, rules: list[FieldRule]) -> None:
        check_name(self.name)
        if not self.meta:
            self._replace(self.frame(), self.frame(), "insert")
        self.db.commit(lambda m: m["collections"][self.name].update(rules=[[r.name, r.type, r.required, r.unique] for r in rules]))

    def schema(self) -> list[FieldRule]:
        return [FieldRule(*r) for r in self.meta["rules"]] if self.meta else []

    # expiry

    def _ttl(self) -> DataFrame:
        if not (self.meta and self.meta.get("ttl")):
            return self.spark.createDataFrame([], "key string, expires_at long")
        return self.spark.read.schema("key string, expires_at long").parquet(f"{self.db.root}/{self.meta['ttl']}")

    def _ttl_put(self, rows: DataFrame) -> None:
        path = self.db.write(self._ttl().join(rows.select("key"), "key", "left_anti").unionByName(rows))
        self.db.commit(lambda m: m["collections"][self.name].update(ttl=path))

    def insert_with_ttl(self, key: str, doc: dict, expires_at: int) -> None:
        self.put(D.frame(self.spark, [(key, doc)]), expiries=self.spark.createDataFrame([(key, expires_at)], "key string, expires_at long"))

    def set_ttl(self, key: str, expires_at: int) -> None:
        self._ttl_put(self.spark.createDataFrame([(key, expires_at)], "key string, expires_at long"))

    def ttl(self, key: str) -> int | None:
        row = self._ttl().where(F.col("key") == key).first()
        return None if row is None else row.expires_at

    def purge_expired(self, now: int) -> int:
        """Removes documents that expire at ``now`` or before; the number of them."""
        return self._delete(self._ttl().where(F.col("expires_at") <= now).select("key"))

    # edges

    def edges(self) -> DataFrame:
        e = self.db.manifest["edges"].get(self.name)
        return self.spark.read.schema(graph.EDGES).parquet(f"{self.db.root}/{e['path']}") if e else self.spark.createDataFrame([], graph.EDGES)

    def _edges_replace(self, rows: DataFrame, events: DataFrame | None = None) -> None:
        path = self.db.write(rows)
        self.db.commit(lambda m: m["edges"].__setitem__(self.name, {"path": path}), events)

    def _edges_put(self, rows: DataFrame) -> None:
        stay = self.edges().join(rows.select("relation", "src", "dst"), ["relation", "src", "dst"], "left_anti")
        events = rows.select(F.lit(self.name).alias("collection"), F.col("src").alias("key"), F.lit("insert").alias("kind"))
        self._edges_replace(stay.select("relation", "src", "dst", "weight").unionByName(rows.select("relation", "src", "dst", "weight")), events)

    def link(self, src: str, relation: str, dst: str, weight: float = 1.0) -> None:
        check_name(self.name)
        self._edges_put(self.spark.createDataFrame([(relation, src, dst, float(weight))], graph.EDGES))

    def unlink(self, src: str, relation: str, dst: str) -> bool:
        hit = (F.col("relation") == relation) & (F.col("src") == src) & (F.col("dst") == dst)
        if not self.edges().where(hit).limit(1).count():
            return False
        event = self.spark.createDataFrame([(self.name, src, "delete")], "collection string, key string, kind string")
        self._edges_replace(self.edges().where(~hit), event)
        return True

    def neighbors(self, key: str, relation: str) -> DataFrame:
        return graph.neighbors(self.edges(), key, relation)

    def in_neighbors(self, key: str, relation: str) -> DataFrame:
        return graph.in_neighbors(self.edges(), key, relation)

    def neighbors_weighted(self, key: str, relation: str) -> DataFrame:
        return graph.neighbors_weighted(self.edges(), key, relation)

    def traverse(self, key: str, relation: str, hops: int) -> DataFrame:
        return graph.traverse(self.edges(), key, relation, hops)

    # indexes: derived tables and layouts

    def _index(self, kind: str, field: str, **more) -> None:
        if not self.meta:
            self._replace(self.frame(), self.frame(), "insert")
        self.db.commit(lambda m: m["collections"][self.name]["indexes"].__setitem__(f"{kind}:{field}", {"kind": kind, "field": field, "path": None, "version": -1, **more}))

    def create_vector_index(self, field: str, metric: str = "cosine", cells: int | None = None, m: int | None = None, k: int = 256, codes: str | None = None) -> None:
        """Inverted lists; with m product-quantized codes instead, or with codes ``binary`` or ``scalar`` ones. Trained now, so that vectors that don't fit are an error here."""
        if codes not in (None, "binary", "scalar") or (codes and m):
            raise InvalidArgument("codes are binary or scalar, and have no m")
        self._index("vector", field, metric=metric, cells=cells, m=m, k=k, codes=codes)
        if m:
            self._codes(f"vector:{field}")

    def _stale(self, name: str) -> bool:
        return self.meta["indexes"][name]["version"] != self.meta["written"]

    def _codes(self, name: str) -> tuple[vector.V.Pq, DataFrame]:
        """(codebooks, rows with their codes), trained and encoded anew when the rows have changed since."""
        i = self.meta["indexes"][name]
        if self._stale(name):
            pq = vector.train_pq(self.frame(), i["field"], i["m"], i["k"])
            coded = vector.with_pq(self.frame(), i["field"], pq)
            done = {"path": self.db.write(coded), "version": self.meta["written"], "books": base64.b64encode(pq.to_bytes()).decode(), "schema": coded.schema.json()}
            self.db.commit(lambda m: m["collections"][self.name]["indexes"][name].update(done))
            i = self.meta["indexes"][name]
        return vector.V.Pq.from_bytes(base64.b64decode(i["books"])), self.db.read(i["path"], i["schema"])

    def _cells(self, name: str) -> tuple:
        """(lists, assigned rows), rebuilt when the rows have changed since."""
        i = self.meta["indexes"][name]
        if self._stale(name):
            lists = vector.InvertedLists.train(self.frame(), i["field"], i["metric"], i["cells"])
            assigned = lists.assign(self.frame(), i["field"])
            path = self.db.write(assigned.repartition("cell").sortWithinPartitions("cell"))
            done = {"path": path, "version": self.meta["written"], "centres": lists.centres.tolist(), "probes": lists.probes, "schema": assigned.schema.json()}
            self.db.commit(lambda m: m["collections"][self.name]["indexes"][name].update(done))
            i = self.meta["indexes"][name]
        import numpy as np

        return vector.InvertedLists(np.array(i["centres"]), i["metric"], i.get("probes", ())), self.db.read(i["path"], i["schema"])

    def create_text_index(self, field: str, stop: bool = True, stems: bool = True) -> None:
        self._index("text", field, stop=stop, stems=stems)

    def _postings(self, field: str) -> tuple[DataFrame, dict, Analyzer]:
        name = f"text:{field}"
        i = self.meta["indexes"][name]
        analyzer = Analyzer(i["stop"], i["stems"])
        if i["version"] != self.meta["written"]:
            rows = text.postings(self.frame(), field, analyzer)
            path = self.db.write(rows.repartition("term").sortWithinPartitions("term", "key"))
            tokens = text._corpus(self.frame(), field, analyzer)
            n, avg = (0, None) if tokens is None else tokens.agg(F.count(F.lit(1)), F.avg(F.size("_tok"))).first()
            done = {"path": path, "version": self.meta["written"], "stats": {"n": n, "avg": avg}, "schema": rows.schema.json()}
            self.db.commit(lambda m: m["collections"][self.name]["indexes"][name].update(done))
            i = self.meta["indexes"][name]
        return self.db.read(i["path"], i["schema"]), i["stats"], analyzer

    def text_search(self, field: str, query: str, k: int) -> DataFrame:
        """key, score over the whole collection, from postings if there are some."""
        if self.meta and f"text:{field}" in self.meta["indexes"]:
            index, stats, analyzer = self._postings(field)
            return text.search_postings(index, stats, text.terms_of(self.spark, analyzer, query), k)
        return text.search(self.frame(), field, query, k).select("key", "score")

    def phrase_search(self, field: str, query: str, k: int) -> DataFrame:
        if self.meta and f"text:{field}" in self.meta["indexes"]:
            index, stats, analyzer = self._postings(field)
            return text.phrase_postings(index, stats, text.terms_of(self.spark, analyzer, query), k)
        return text.phrase(self.frame(), field, query, k).select("key", "score")

    def vector_search(self, field: str, query, k: int, metric: str = "cosine") -> DataFrame:
        """The k nearest rows with their distance: through the field's index of that metric if there is one, else exactly."""
        name = f"vector:{field}"
        if not (self.meta and name in self.meta["indexes"] and self.meta["indexes"][name]["metric"] == metric and len(self)):
            return vector.exact(self.frame(), field, query, k, metric)
        found = self.vector_search_batch(field, [("", [float(x) for x in query])], k)
        return self.frame().join(found.select("key", "distance"), "key").orderBy("distance", "key")

    def vector_search_batch(self, field: str, queries: list[tuple], k: int) -> DataFrame:
        """query, rank, key, distance of many queries through the field's index: codes or cells give candidates, exact distances rank them."""
        i = self.meta["indexes"][f"vector:{field}"]
        if i.get("m"):
            pq, coded = self._codes(f"vector:{field}")
            return vector.batch_by_pq(coded, field, pq, queries, k, i["metric"])
        if i.get("codes"):
            return vector.batch_by_codes(self.frame(), field, queries, k, i["metric"], i["codes"])
        lists, assigned = self._cells(f"vector:{field}")
        return lists.search_batch(assigned, field, queries, k)

    def create_scalar_index(self, field: str) -> None:
        self.create_compound_index([field])

    def create_compound_index(self, fields: list[str]) -> None:
        """Lays the rows out in the order of the fields, so that files' statistics answer comparisons on a leading prefix of them."""
        self._index("layout", ",".join(fields))
        here = [f for f in fields if f.split(".")[0] in self.frame().columns]
        if here and len(self):
            self._replace(self.frame().repartitionByRange(*[F.col(f) for f in here]).sortWithinPartitions(*here), self.frame().select("key").limit(0), "insert")

    def create_geo_index(self, field: str) -> None:
        """Lays the rows out by cells of a tenth of a degree."""
        self._index("geo", field)
        if len(self):
            df = cells(self.frame(), field)
            self._replace(df.repartitionByRange("lat_cell", "lon_cell").sortWithinPartitions("lat_cell", "lon_cell").drop("lat_cell", "lon_cell"), self.frame().select("key").limit(0), "insert")


def same(a, b) -> bool:
    """Equal in value and kind, NaN equal to itself."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b)
    if isinstance(a, bool) != isinstance(b, bool) or isinstance(a, float) != isinstance(b, float):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) == set(b) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return a == b
