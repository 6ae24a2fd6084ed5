"""A dispatcher of named tools with JSON parameters over a database."""

from __future__ import annotations

from ..errors import InvalidArgument, LakeError
from ..functions.text import Bm25
from ..operators import geo
from ..plans.predicates import from_json
from .documents import from_wire, plain
from .schema import FieldRule
from .store import Database, check_name

#: Rows that a call returns at most, by default and at the limit; keys that a deletion takes at most.
USUAL, MOST, MOST_KEYS = 100, 1000, 10_000


class Tools:
    def __init__(self, db: Database):
        self.db = db

    def names(self) -> list[str]:
        return sorted(n[5:] for n in dir(self) if n.startswith("tool_"))

    def handle(self, tool: str, params: dict | None = None) -> dict:
        f = getattr(self, f"tool_{tool}", None)
        if f is None:
            raise InvalidArgument(f"unknown tool {tool}")
        try:
            return f(**(params or {}))
        except TypeError as e:
            raise InvalidArgument(str(e)) from e

    def _c(self, name: str):
        return self.db.collection(name)

    @staticmethod
    def _limit(n: int | None) -> int:
        if n is not None and not 0 <= n <= MOST:
            raise InvalidArgument(f"a limit is from 0 to {MOST}")
        return USUAL if n is None else n

    def _rows(self, df, *numbers: str) -> dict:
        out = []
        for r in df.collect():
            d = self._c("")._doc(r)
            out.append({"key": r.key, **{n: d.pop(n, None) for n in numbers}, "doc": plain(d)})
        return {"rows": out}

    def tool_store(self, collection, key, doc, expires_at=None):
        self._c(collection).insert(key, from_wire(doc))
        if expires_at is not None:
            self._c(collection).set_ttl(key, expires_at)
        return {"ok": True}

    def tool_insert_auto(self, collection, doc):
        return {"key": self._c(collection).insert_auto(from_wire(doc))}

    def tool_get(self, collection, key):
        d = self._c(collection).get(key)
        return {"found": d is not None, "doc": plain(d)}

    def tool_delete(self, collection, key=None, keys=None):
        keys = [key] if keys is None else keys
        if len(keys) > MOST_KEYS:
            raise InvalidArgument(f"at most {MOST_KEYS} keys")
        return {"deleted": self._c(collection).delete_batch(keys)}

    def tool_delete_where(self, collection, filter):
        return {"deleted": self._c(collection).delete_where(from_json(filter))}

    def tool_patch(self, collection, key, patch):
        self._c(collection).patch(key, from_wire(patch))
        return {"ok": True}

    def tool_compare_and_set(self, collection, key, expected=None, new=None):
        return {"swapped": self._c(collection).compare_and_set(key, from_wire(expected), from_wire(new))}

    def tool_search(self, collection, filter=None, vector=None, text=None, limit=None, offset=0, order_by=None, select=None, rrf_k=None, mmr=None, approx=False):
        q = self._c(collection).query()
        if filter is not None:
            q = q.filter(from_json(filter))
        n = self._limit(limit)
        if vector is not None:
            q = q.vector(vector["field"], vector["query"], vector.get("k", n), vector.get("metric", "cosine"))
        if text is not None:
            q = q.text(text["field"], text["query"], text.get("k", n))
        if rrf_k is not None:
            q = q.fuse_rrf(rrf_k)
        if mmr is not None:
            q = q.rerank_mmr(mmr)
        if order_by is not None:
            q = q.order_by(order_by["field"], order_by.get("desc", False))
        if select is not None:
            q = q.select(*select)
        if approx:
            q = q.approx()
        return self._rows(q.offset(offset).limit(n).run(), "score")

    def tool_phrase_search(self, collection, field, phrase, k=None):
        Bm25().validate()
        return {"rows": [r.asDict() for r in self._c(collection).phrase_search(field, phrase, self._limit(k)).collect()]}

    def tool_page(self, collection, after=None, limit=None, filter=None):
        rows, following = self._c(collection).page(after, self._limit(limit), None if filter is None else from_json(filter))
        return self._rows(rows) | {"next": following}

    def tool_count(self, collection, filter=None):
        q = self._c(collection).query()
        return {"count": (q if filter is None else q.filter(from_json(filter))).count().first()[0]}

    def tool_list_collections(self):
        return {"collections": self.db.collections()}

    def tool_link(self, collection, src, relation, dst, weight=1.0):
        self._c(collection).link(src, relation, dst, weight)
        return {"ok": True}

    def tool_unlink(self, collection, src, relation, dst):
        return {"removed": self._c(collection).unlink(src, relation, dst)}

    def _keys(self, df) -> dict:
        return {"keys": [r.key for r in df.limit(MOST).collect()]}

    def tool_neighbors(self, collection, key, relation):
        return self._keys(self._c(collection).neighbors(key, relation))

    def tool_in_neighbors(self, collection, key, relation):
        return self._keys(self._c(collection).in_neighbors(key, relation))

    def tool_traverse(self, collection, key, relation, hops):
        return self._keys(self._c(collection).traverse(key, relation, hops))

    def tool_create_index(self, collection, field, metric="cosine", m=None, k=256):
        self._c(collection).create_vector_index(field, metric, m=m, k=k)
        return {"ok": True}

    def tool_create_text_index(self, collection, field):
        self._c(collection).create_text_index(field)
        return {"ok": True}

    def tool_create_scalar_index(self, collection, field):
        self._c(collection).create_scalar_index(field)
        return {"ok": True}

    def tool_create_compound_index(self, collection, fields):
        self._c(collection).create_compound_index(fields)
        return {"ok": True}

    def tool_create_geo_index(self, collection, field):
        self._c(collection).create_geo_index(field)
        return {"ok": True}

    def tool_geo(self, collection, field, kind, limit=None, **at):
        df, n = self._c(collection).frame(), self._limit(limit)
        if kind == "radius":
            return self._rows(geo.radius(df, field, at["lat"], at["lon"], at["radius_km"]).limit(n), "distance_km")
        if kind == "nearest":
            return self._rows(geo.nearest(df, field, at["lat"], at["lon"], n), "distance_km")
        if kind == "bbox":
            return self._rows(geo.box(df, field, at["min_lat"], at["min_lon"], at["max_lat"], at["max_lon"]).limit(n))
        raise InvalidArgument(f"unknown kind {kind}")

    def tool_join(self, collection, other, field, limit=None):
        from .documents import shown

        rows = self._c(collection).join(other, field).limit(self._limit(limit)).collect()
        return {"rows": [{"key": r.key, "left": plain(shown(r.left)), "right": plain(shown(r.right))} for r in rows]}

    def tool_set_schema(self, collection, fields):
        self._c(collection).set_schema([FieldRule(f["name"], f.get("type", "any"), f.get("required", False), f.get("unique", False)) for f in fields])
        return {"ok": True}

    def tool_get_schema(self, collection):
        return {"fields": [vars(r) for r in self._c(collection).schema()]}

    def tool_backup(self, path):
        self.db.backup(path)
        return {"ok": True}

    def tool_dump(self, path):
        self.db.dump(path)
        return {"ok": True}

    def tool_load(self, path, renames=None):
        for to in (renames or {}).values():
            check_name(to)
        self.db.load(path, renames)
        return {"ok": True}


__all__ = ["LakeError", "Tools"]
