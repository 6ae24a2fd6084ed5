"""Benchmark decontamination over a distributed positional inverted index.

The index is divided by documents: a row (segment) holds the postings of some megabytes of whole documents. For each term
of a segment, found by the 64-bit hash of its word in a sorted dictionary, it has the ascending positions of the term in the
row of all the segment's words. A query looks its terms up in each segment, starts from the term with the fewest postings
and intersects the lists, each moved by its term's offset. A segment answers by itself, so nothing is shuffled and no
term's list, however long over the corpus, meets in one place.

The test set is written to the shared folder in blocks of some megabytes. A task reads them one after the other for each of
its segments, so a document's matches come together where its postings are, whatever the size of the test set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, buffers, frugal, mixed, scratch, ship, slices, word_hashes

#: Text bytes of a segment; a longer document is a segment of its own.
SEGMENT = 4 << 20
#: Bytes of test text that are searched for at a time; a larger test set is several blocks. Blocks that a process keeps in memory.
BLOCK, HELD = 4 << 20, 4
INDEX = "doc_ids array<long>, starts array<long>, terms binary, firsts binary, postings binary"
_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def invert(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, start of each one's list, all lists) of a row of words."""
    n = len(h)
    if n == 0:
        return h, np.zeros(1, np.int64), np.zeros(0, np.uint32)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    key.sort()
    at = (key & low).astype(np.int64)
    found = h[at]
    new = found[1:] != found[:-1]
    if (new & ((found[1:] & ~low) == (found[:-1] & ~low))).any():  # two words alike in the upper bits
        at = np.argsort(h, kind="stable")
        found = h[at]
        new = found[1:] != found[:-1]
    firsts = np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
    return found[firsts[:-1]], firsts, at.astype(np.uint32)


def build(docs: DataFrame, path: str) -> DataFrame:
    """Writes the index of all words of doc_id and text under path and returns it. Null text has no words."""
    ship(docs.sparkSession)

    def segments(batches):
        frugal()
        for b in slices(batches, 1, SEGMENT):
            raw, offsets = buffers(b.column(1))
            ids, i, n = b.column(0).to_pylist(), 0, b.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
                h, starts = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD_BYTES)
                terms, firsts, postings = invert(h)
                row = [ids[i:j], starts, terms.tobytes(), firsts.astype("<i8").tobytes(), postings.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=["doc_ids", "starts", "terms", "firsts", "postings"])
                i = j

    index = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(segments, INDEX)
    index.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Segment:
    def __init__(self, starts, terms: bytes, firsts: bytes, postings: bytes):
        self.starts = np.asarray(starts, np.int64)
        self.terms, self.firsts, self.postings = np.frombuffer(terms, np.uint64), np.frombuffer(firsts, "<i8"), np.frombuffer(postings, np.uint32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the dictionary, postings), 0 postings for words that the segment hasn't."""
        if not len(self.terms):
            return np.zeros(h.shape, np.int64), np.zeros(h.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return at, np.where(self.terms[at] == h, self.firsts[at + 1] - self.firsts[at], 0)

    def list(self, at: int) -> np.ndarray:
        return self.postings[self.firsts[at] : self.firsts[at + 1]].astype(np.int64)

    def document(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, p, "right") - 1

    def phrase(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where the words of these dictionary places stand one after the other in one document."""
        order = np.argsort(counts, kind="stable")
        p = self.list(at[order[0]]) - order[0]
        for k in order[1:]:
            if not len(p):
                return p
            held = self.list(at[k])
            i = np.minimum(np.searchsorted(held, p + k), len(held) - 1)
            p = p[held[i] == p + k]
        p = p[p >= 0]
        return p[p + len(at) <= self.starts[self.document(p) + 1]]

    def near(self, at: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
        """Starts of stretches of ``width`` words of one document (or its end) that begin at one of these words and hold them all, in any order."""
        rare = self.list(at[int(np.argmin(counts))])
        s = np.unique((rare[:, None] - np.arange(width)[None, :]).ravel())
        s = s[s >= 0]
        end = np.minimum(s + width, self.starts[np.minimum(self.document(s) + 1, len(self.starts) - 1)])
        starts = np.zeros(len(s), bool)
        ok = np.ones(len(s), bool)
        for a in np.unique(at):
            held = self.list(a)
            first = held[np.minimum(np.searchsorted(held, s), len(held) - 1)]
            ok &= (first >= s) & (first < end)
            starts |= first == s
        return s[ok & starts]


class Block:
    """Windows of some test items: ``size`` words each, or all words of a shorter item; equal windows are one with all their items."""

    def __init__(self, items: list[str], h: np.ndarray, starts: np.ndarray, size: int):
        self.items = items
        self.words, self.of = np.unique(h, return_inverse=True)
        count = np.diff(starts)
        #: By window length: first words (places in ``of``), and of each the range of its items in ``owners``.
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.owners: dict[int, np.ndarray] = {}
        for k in np.unique(np.minimum(count[count > 0], size)).tolist():
            mine = np.flatnonzero(count >= size if k == size else count == k)
            n = count[mine] - k + 1
            at = np.repeat(starts[:-1][mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            owner, total = np.repeat(mine, n), np.zeros(len(at), np.uint64)
            for j in range(k):
                total = mixed(total ^ h[at + j]) + np.uint64(j)
            order = np.argsort(total, kind="stable")
            at, owner, total = at[order], owner[order], total[order]
            new = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]]))
            self.groups[k] = (at[new], np.append(new, len(at)))
            self.owners[k] = owner

    def names(self, k: int, w: int) -> set[str]:
        ranges = self.groups[k][1]
        return {self.items[i] for i in self.owners[k][ranges[w] : ranges[w + 1]].tolist()}


_BLOCKS = "items array<string>, starts binary, words binary"
_HELD: dict[tuple[str, int], list[Block]] = {}


def write_items(items: DataFrame, path: str) -> list[str]:
    """Writes the words of item_id and text under path in blocks; returns the files. A null item_id is written as empty; items without words stay, and match nothing."""
    ship(items.sparkSession)
    sized = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0

    most = BLOCK

    def hashed(batches):
        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            h, starts = word_hashes(*buffers(t.column(1)), WORD_BYTES)
            return pa.RecordBatch.from_arrays([pa.array([t.column(0).to_pylist()], pa.list_(pa.string())), pa.array([starts.astype("<i8").tobytes()]), pa.array([h.tobytes()])], names=["items", "starts", "words"])

        held, n = [], 0
        for b in slices(batches, 1, most):
            if held and n + b.nbytes > most:
                yield block()
                held, n = [], 0
            held.append(b)
            n += b.nbytes
        if held:
            yield block()

    sized.repartition(max(1, -(-int(total) // most))).mapInArrow(hashed, _BLOCKS).write.parquet(path)
    return sorted(items.sparkSession.read.schema(_BLOCKS).parquet(path).inputFiles())


def read_blocks(files: list[str], size: int):
    """The blocks of the files, one after the other; files of HELD blocks at most in all stay in memory for the next segment."""
    if any(f not in files for f, _ in _HELD):
        _HELD.clear()
    for f in files:
        if (f, size) in _HELD:
            yield from _HELD[f, size]
            continue
        fs, at = pafs.FileSystem.from_uri(f)
        found, count = [], 0
        for b in pq.ParquetFile(fs.open_input_file(at)).iter_batches(1):
            for r in b.to_pylist():
                block = Block(r["items"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["starts"], "<i8"), size)
                yield block
                count += 1
                found = [*found, block] if count + sum(map(len, _HELD.values())) <= HELD else []
        if len(found) == count:
            _HELD[f, size] = found


def search(index: DataFrame, items: DataFrame, size: int = 13, width: int | None = None, everything: bool = False, path: str | None = None) -> DataFrame:
    """Matches of the items (item_id, text): doc_id, n_words, spans array<struct(start, end)>, items array<string>.

    Exact: each window of ``size`` words of an item is a phrase, all words of a shorter item are one. With ``width``: each
    window's words in any order within so many words. spans: word positions in the document, overlapping ones joined. A row
    for each document with a match, or with ``everything`` for each document; repeated and null doc_ids are rows of their own.
    """
    files = write_items(items, path or scratch(items.sparkSession, "items"))
    kind = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def answers(seg: Segment) -> tuple[dict[int, list], dict[int, set]]:
        spans: dict[int, list] = {}
        names: dict[int, set] = {}
        for block in read_blocks(files, size):
            at, counts = (x[block.of] for x in seg.look_up(block.words))
            for k, (first, _) in block.groups.items():
                least = counts[first]
                for j in range(1, k):
                    least = np.minimum(least, counts[first + j])
                for w in np.flatnonzero(least > 0).tolist():
                    own = slice(first[w], first[w] + k)
                    p = seg.phrase(at[own], counts[own]) if width is None else seg.near(at[own], counts[own], width)
                    if len(p):
                        d = seg.document(p)
                        for doc, s in zip(d.tolist(), (p - seg.starts[d]).tolist(), strict=True):
                            spans.setdefault(doc, []).append((s, s + (k if width is None else width)))
                            names.setdefault(doc, set()).update(block.names(k, w))
        return spans, names

    def join(found: list, most: int) -> list[dict]:
        out: list[list[int]] = []
        for s, e in sorted(found):
            e = min(e, most)
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [{"start": s, "end": e} for s, e in out]

    def matches(batches):
        frugal()
        for b in batches:
            for r in range(b.num_rows):
                ids, starts, *rest = (c[r] for c in b.columns)
                seg = Segment(starts.values.to_numpy(), *[x.as_buffer() for x in rest])
                spans, names = answers(seg)
                ids, n = ids.as_py(), np.diff(seg.starts).tolist()
                rows = range(len(ids)) if everything else sorted(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in rows], pa.int64()), pa.array([n[d] for d in rows], pa.int64()), pa.array([join(spans.get(d, ()), n[d]) for d in rows], span), pa.array([sorted(names.get(d, ())) for d in rows], pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(matches, kind)


def contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans: a row for each document.

    A document is contaminated if it has a hit word and these are one in ``share`` or more of its words. Null texts have no
    words; items without words match nothing; items with one id are one item, those without an id are the item of the empty
    id; repeated documents, and those with null ids, are rows of their own. No items: no hits. No documents: no rows. Columns
    of docs but doc_id and text aren't read, so their names don't matter.
    """
    found = search(build(docs, path or scratch(docs.sparkSession, "postings")), items, size, everything=True)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    hit = F.aggregate(F.array_sort("spans"), zero, lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.end - F.greatest(a.to, x.start))).alias("n"), F.greatest(a.to, x.end).alias("to"))).n
    out = found.withColumn("n_hit", F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("long")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans",
    )
