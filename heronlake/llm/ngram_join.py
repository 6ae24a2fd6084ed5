"""Jaccard self-join of word n-gram sets over a prefix tree; exact up to equal 64-bit fingerprints of different n-grams.

1. Every text's distinct n-grams, as 64-bit fingerprints, are dealt by fingerprint, packed by the thousand; there each
   n-gram's number of texts is counted, and n-grams of one text alone are dropped.
2. Back by text, a text of n n-grams with fewer than t * n shared ones is linked with nothing. Of the others equal sets
   become one class; sets are ordered by frequency, rarest first, which is the global order.
3. Classes that share an n-gram within their prefixes may be similar. Their components are found from links that each
   share of the n-grams makes by itself, a link for each class at most.
4. Each component's sets go into a trie, frequent n-grams first, so that near copies share long paths. Every set walks it
   once, carrying the overlap so far; subtrees are left out whose remaining lengths can't make the overlap that their
   smallest set needs, or whose sets are all in the walker's component already. Components too large for a task are walked
   in groups instead, one for each n-gram that sets share in their prefixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, buffers, cut, frugal, mixed, parts, scratch, ship, slices, word_hashes
from .graph import components

#: Texts and text bytes of a chunk; the number of texts must fit 12 bits.
CHUNK, CHUNK_BYTES = 4095, 2 << 20
#: Stands for a text where an n-gram has several in its chunk.
SEVERAL = 65535
#: Shares of the fingerprints for each partition of the input (rounded to a power of two); shares for candidate links at least, else as many as partitions.
SHARES, LINK_SHARES = 8, 32
#: N-grams of a component that are joined in one task; larger components are divided by the n-grams of their sets' prefixes.
TASK = 4_000_000
#: Rows that are broadcast at most.
SMALL = 500_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]


def ngram_prints(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit fingerprint of each distinct n-gram, its text, n-grams of each text) of a chunk of CHUNK texts at most, by fingerprint, then text."""
    h, starts = word_hashes(raw, offsets, SPACE_BYTES)
    count = np.diff(starts)
    n = len(count)
    mult = [_ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1) for k in range(size)]
    prints, texts = [], []
    whole = count >= size
    if whole.any():
        total = h[: len(h) - size + 1] * mult[0]
        for k in range(1, size):
            total = total + h[k : len(h) - size + 1 + k] * mult[k]
        grams = np.where(whole, count - size + 1, 0)
        at = np.repeat(starts[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
        texts.append(np.repeat(np.arange(n, dtype=np.uint16), grams))
        prints.append(mixed(total[at]))
    short = np.flatnonzero((count > 0) & ~whole)
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            total[has] += h[starts[short[has]] + k] * mult[k]
        total += count[short].astype(np.uint64) * _ODD[-1]
        prints.append(mixed(total))
        texts.append(short.astype(np.uint16))
    if not prints:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(n, np.int64)
    print_, text = np.concatenate(prints), np.concatenate(texts)
    low = np.uint64(4095)
    order = np.argsort((print_ & ~low) | text)
    sorted_ = print_[order]
    if ((sorted_[1:] != sorted_[:-1]) & ((sorted_[1:] | low) == (sorted_[:-1] | low))).any():  # two alike but for the last bits
        order = np.lexsort((text, print_))
        sorted_ = print_[order]
    text = text[order]
    once = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (text[1:] != text[:-1])])
    print_, text = sorted_[once], text[once]
    return print_, text, np.bincount(text, minlength=n)


#: Bits of a fingerprint that a share's number holds at least; the others go along as 7 bytes.
TOP = 8


def _split(print_: np.ndarray) -> bytes:
    """The lower 56 bits as planes: the byte that varies least comes first, and all of it compresses."""
    return (print_ >> np.uint64(48)).astype(np.uint8).tobytes() + (print_ >> np.uint64(32)).astype("<u2").tobytes() + print_.astype("<u4").tobytes()


def _joined(data, n: int, at: int, share: int, bits: int) -> np.ndarray:
    """Fingerprints of a share from their planes."""
    top = np.frombuffer(data, np.uint8, n, at).astype(np.uint64) | np.uint64(share >> (bits - TOP) << 8)
    return (top << np.uint64(48)) | (np.frombuffer(data, "<u2", n, at + n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(data, "<u4", n, at + 3 * n)


def _packed(share: list, chunk: list, payload: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())], names=["share", "chunk", "payload"])


_PACKED = "share int, chunk long, payload binary"


def _deal(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """A row for each chunk and share with its n-grams (fingerprint, text or SEVERAL, their numbers), and one of a negative share
    with the texts' ids and counts, and the n-grams that several of them have. So a share gets an n-gram once for each chunk, however many texts hold it."""

    def run(batches):
        frugal()
        first, k = TaskContext.get().partitionId() << 32, 0
        for b in slices(batches, 1, CHUNK_BYTES):
            raw, offsets = buffers(b.column(1))
            ids, none = np.array(b.column(0).fill_null(0)), np.array(b.column(0).is_null())
            i, n = 0, b.num_rows
            while i < n:
                j = min(i + CHUNK, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
                print_, text, count = ngram_prints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                text = text.astype("<u2")
                # Those of several texts here go to their share once, with their number.
                at = np.flatnonzero(np.concatenate([[True], print_[1:] != print_[:-1]])) if len(print_) else np.zeros(0, int)
                run_ = np.diff(np.append(at, len(print_)))
                here = np.repeat(run_ > 1, run_)
                one = np.where(run_ > 1, SEVERAL, text[at]).astype("<u2")
                share = (print_[at] >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(share[1:] != share[:-1]) + 1, [len(share)]]) if len(share) else np.zeros(1, int)
                rows = []
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    many = run_[x:y][one[x:y] == SEVERAL].astype("<u4")
                    rows.append((int(share[x]), first + k, np.array([y - x], "<u4").tobytes() + _split(print_[at[x:y]]) + one[x:y].tobytes() + many.tobytes()))
                head = np.array([j - i], "<u4").tobytes() + ids[i:j].astype("<i8").tobytes() + count.astype("<i8").tobytes() + none[i:j].astype(np.uint8).tobytes()
                head += print_[here].astype("<u8").tobytes() + text[here].tobytes()
                rows.append((-1 - k % (1 << bits), first + k, head))
                for x in range(0, len(rows), 512):
                    yield _packed(*map(list, zip(*rows[x : x + 512], strict=True)))
                i, k = j, k + 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PACKED)


def _grouped(batches, column: int):
    """(value, its rows) of sorted batches."""
    held, now = [], None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and r[column] != now:
                yield now, held
                held = []
            now = r[column]
            held.append(r)
    if held:
        yield now, held


def _count(dealt: DataFrame, bits: int) -> DataFrame:
    """By share: n-grams of two texts or more, back to their chunks: fingerprint, texts with it (65,535 at most), text or SEVERAL."""

    def run(batches):
        frugal()
        for share, rows in _grouped(batches, 0):
            if share < 0:
                yield _packed(*map(list, zip(*rows, strict=True)))
                continue
            sizes = np.array([int(np.frombuffer(r[2], "<u4", 1)[0]) for r in rows])
            print_ = np.concatenate([_joined(r[2], n, 4, share, bits) for r, n in zip(rows, sizes.tolist(), strict=True)])
            text = np.concatenate([np.frombuffer(r[2], "<u2", n, 4 + 7 * n) for r, n in zip(rows, sizes.tolist(), strict=True)])
            many = np.concatenate([np.frombuffer(r[2], "<u4", -1, 4 + 9 * n) if len(r[2]) > 4 + 9 * n else np.zeros(0, "<u4") for r, n in zip(rows, sizes.tolist(), strict=True)])
            weight = np.ones(len(print_), np.int64)
            weight[text == SEVERAL] = many
            row = np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(print_)
            sorted_ = print_[order]
            new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
            texts = np.add.reduceat(weight[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            some = np.flatnonzero(texts > 1)
            if not len(some):
                continue
            at = order[some]
            order = np.argsort(at)
            at, texts = at[order], np.minimum(texts[some][order], 65535).astype("<u2")
            owner = row[at]
            cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
            out = [(share, rows[owner[x]][1], _split(print_[at[x:y]]) + texts[x:y].tobytes() + text[at[x:y]].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for x in range(0, len(out), 512):
                yield _packed(*map(list, zip(*out[x : x + 512], strict=True)))

    return dealt.mapInArrow(run, _PACKED)


_SETS = "row long, doc_id long, n long, shared long, grams binary, sig binary"


def needed(n, percent: int):
    """Least overlap with which a set of n can reach the similarity: percent of n, rounded up."""
    return -(-n * percent // 100)


def _sets(counted: DataFrame, percent: int, bits: int) -> DataFrame:
    """By chunk: row (its own number of each text), doc_id, n, shared, and of texts that may have a partner the shared n-grams, rarest first, and their digest."""
    import hashlib

    def run(batches):
        frugal()
        for chunk, rows in _grouped(batches, 1):
            head = next(r[2] for r in rows if r[0] < 0)
            n = int(np.frombuffer(head, "<u4", 1)[0])
            ids, count, none = np.frombuffer(head, "<i8", n, 4), np.frombuffer(head, "<i8", n, 4 + 8 * n), np.frombuffer(head, np.uint8, n, 4 + 16 * n)
            m = (len(head) - 4 - 17 * n) // 10
            own_gram, own_text = np.frombuffer(head, "<u8", m, 4 + 17 * n), np.frombuffer(head, "<u2", m, 4 + 17 * n + 8 * m)
            gram, texts, text = [], [], []
            for r in rows:
                if r[0] >= 0:
                    c = len(r[2]) // 11
                    gram.append(_joined(r[2], c, 0, r[0], bits))
                    texts.append(np.frombuffer(r[2], "<u2", c, 7 * c))
                    text.append(np.frombuffer(r[2], "<u2", c, 9 * c))
            if gram:
                gram, texts, text = np.concatenate(gram), np.concatenate(texts), np.concatenate(text)
                if m:
                    several = text == SEVERAL
                    order = np.argsort(gram[several])
                    known, number = gram[several][order], texts[several][order]
                    gram, text = np.concatenate([gram[~several], own_gram]), np.concatenate([text[~several], own_text])
                    texts = np.concatenate([texts[~several], number[np.searchsorted(known, own_gram)]])
                order = np.lexsort((gram, texts, text))
                gram, text = gram[order], text[order]
                shared = np.bincount(text, minlength=n)
                starts = np.concatenate([[0], np.cumsum(shared)])
            else:
                shared, starts = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
            may = (count > 0) & (shared >= needed(count, percent))
            grams = [gram[starts[d] : starts[d + 1]].tobytes() if may[d] else None for d in range(n)]
            sig = [x and hashlib.blake2b(x, digest_size=16).digest() for x in grams]
            own = (np.int64(chunk) << 12) + np.arange(n)
            size = 1024
            for x in range(0, n, size):
                y = min(n, x + size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[x:y], pa.int64()), pa.array(ids[x:y], pa.int64(), mask=none[x:y].astype(bool)), pa.array(count[x:y], pa.int64()), pa.array(shared[x:y], pa.int64()), pa.array(grams[x:y], pa.binary()), pa.array(sig[x:y], pa.binary())],
                    names=["row", "doc_id", "n", "shared", "grams", "sig"],
                )

    return counted.mapInArrow(run, _SETS)


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, links a[i] - b[i] among nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def prefix(grams: bytes, n: int, shared: int, percent: int) -> np.ndarray:
    """The rarest shared n-grams of a set of n, of which any similar set must have one in its own prefix."""
    return np.frombuffer(grams, "<u8")[: max(1, n - needed(n, percent) + 1 - (n - shared))]


def _candidates(classes: DataFrame, percent: int, shares: int) -> DataFrame:
    """u, v: links between classes that share an n-gram within their prefixes, a spanning forest for each share of the n-grams."""

    def deal(batches):
        frugal()
        for b in batches:
            gram, owner = [], []
            for c, n, shared, grams in zip(*(x.to_pylist() for x in b.columns), strict=True):
                g = prefix(grams, n, shared, percent)
                gram.append(g)
                owner.append(np.full(len(g), c, np.int64))
            if not gram:
                continue
            gram, owner = np.concatenate(gram), np.concatenate(owner)
            # Owners of one n-gram here are linked here; one of them stands for all beyond.
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
            same = np.flatnonzero(gram[1:] == gram[:-1])
            ids, node = np.unique(owner, return_inverse=True)
            root = roots_of(node[same], node[same + 1], len(ids))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            rows = [(int(ids[0] % shares), 1, ids[moved].tobytes() + ids[root[moved]].tobytes())] if len(moved) else []
            once = np.concatenate([[True], gram[1:] != gram[:-1]])
            gram, owner = gram[once], owner[once]
            share = (mixed(gram) % np.uint64(shares)).astype(np.int32)
            order = np.argsort(share, kind="stable")
            gram, owner, share = gram[order], owner[order], share[order]
            cuts = np.concatenate([[0], np.flatnonzero(share[1:] != share[:-1]) + 1, [len(share)]])
            rows += [(int(share[x]), 0, gram[x:y].tobytes() + owner[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield _packed(*map(list, zip(*rows, strict=True)))

    def link(batches):
        frugal()
        for _, rows in _grouped(batches, 0):
            half = lambda kind, flag, second: np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[2], kind, len(r[2]) // 16, second * (len(r[2]) // 2)) for r in rows if r[1] == flag]])
            gram, owner, u, v = half("<u8", 0, 0), half("<i8", 0, 1), half("<i8", 1, 0), half("<i8", 1, 1)
            order = np.argsort(gram)
            gram, owner = gram[order], owner[order]
            ids, node = np.unique(np.concatenate([owner, u, v]), return_inverse=True)
            same, m = np.flatnonzero(gram[1:] == gram[:-1]), len(owner)
            root = roots_of(np.concatenate([node[same], node[m : m + len(u)]]), np.concatenate([node[same + 1], node[m + len(u) :]]), len(ids))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            for x in range(0, len(moved), 1 << 16):
                m = moved[x : x + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[m]), pa.array(ids[root[m]])], names=["u", "v"])

    dealt = classes.select("class_id", "n", "shared", "grams").mapInArrow(deal, _PACKED)
    return dealt.repartition(shares, "share").sortWithinPartitions("share").mapInArrow(link, "u long, v long")


class Trie:
    """Sets of dense ranks (frequent first) as a trie whose paths without branches are one node, in arrays.

    Sets are in lexicographic order, so a node's sets are a range. A node holds its own ranks as a range of ``ranks``, the
    smallest set size (n) and the greatest remaining length below it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sets: sorted ranks, in lexicographic order; sizes: the whole sets' n."""
        self.ranks = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        m = len(sets)
        common = [0] * (m + 1)
        for i in range(1, m):
            a, b = sets[i - 1], sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            common[i] = int(differ[0]) if len(differ) else k
        nodes: list[list] = []  # set whose ranks it shows, from depth, to depth, first set, last set + 1, parent
        stack: list[int] = []
        for i in range(m):
            depth = common[i]
            while stack and nodes[stack[-1]][1] >= depth:  # it lies beyond what the set has in common with the one before
                nodes[stack.pop()][4] = i
            if stack and nodes[stack[-1]][2] > depth:  # a branch within a node's path: its upper part becomes a node
                lower = stack.pop()
                shown, top, _, first, _, parent = nodes[lower]
                nodes.append([shown, top, depth, first, 0, parent])
                nodes[lower][1], nodes[lower][4], nodes[lower][5] = depth, i, len(nodes) - 1
                stack.append(len(nodes) - 1)
            nodes.append([i, depth, len(sets[i]), i, 0, stack[-1] if stack else -1])
            stack.append(len(nodes) - 1)
        for x in stack:
            nodes[x][4] = m
        table = np.array(nodes, np.int64).reshape(-1, 6)
        self.start, self.end = at[table[:, 0]] + table[:, 1], at[table[:, 0]] + table[:, 2]
        self.depth, self.lo, self.hi, parent = table[:, 2], table[:, 3], table[:, 4], table[:, 5]
        length = np.array([len(s) for s in sets], np.int64)
        self.least = np.array([sizes[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        self.longest = np.array([length[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        order = np.argsort(parent, kind="stable")
        self.children, counts = order, np.bincount(parent + 1, minlength=len(nodes) + 1)
        self.child_at = np.concatenate([[0], np.cumsum(counts)])
        self.length = length

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children, place of each one's parent in ``nodes``); -1 is above the roots."""
        a, b = self.child_at[nodes + 1], self.child_at[nodes + 2]
        n = b - a
        of = np.repeat(np.arange(len(nodes)), n)
        return self.children[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], of


def trie_join(grams: list[np.ndarray], sizes: np.ndarray, percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Label of each set: the least index, or least given label, of its component of similar sets."""
    m = len(grams)
    flat = np.concatenate(grams)
    values, dense, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank_of = np.empty(len(values), np.int64)
    rank_of[np.argsort(-count, kind="stable")] = np.arange(len(values))
    ranks = rank_of[dense]
    at = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    sets = [np.sort(ranks[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(m), key=lambda i: sets[i].astype(">u4").tobytes())
    sets, n = [sets[i] for i in order], sizes[order]
    label = (np.arange(m) if labels is None else labels)[order].copy()
    trie = Trie(sets, n)
    mine = np.zeros(len(values), bool)
    for x in range(m):
        if (label[x + 1 :] == label[x]).all():
            continue
        mine[sets[x]] = True
        nodes, overlap = np.array([-1]), np.zeros(1, np.int64)
        while True:
            nodes, of = trie.below(nodes)
            overlap = overlap[of]
            keep = trie.hi[nodes] > x + 1
            nodes, overlap = nodes[keep], overlap[keep]
            if not len(nodes):
                break
            size = trie.end[nodes] - trie.start[nodes]
            own = np.repeat(trie.start[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            ends = np.cumsum(size)
            hits = np.concatenate([[0], np.cumsum(mine[trie.ranks[own]])])
            overlap = overlap + hits[ends] - hits[ends - size]
            # A node without ranks of its own holds the empty set, which has no place here.
            last = trie.ranks[np.maximum(trie.end[nodes] - 1, 0)]
            left = len(sets[x]) - np.searchsorted(sets[x], last, "right")
            best = overlap + np.minimum(left, trie.longest[nodes] - trie.depth[nodes])
            keep = (100 + percent) * best >= percent * (n[x] + trie.least[nodes])
            for k in np.flatnonzero(keep):
                a, b = max(x + 1, trie.lo[nodes[k]]), trie.hi[nodes[k]]
                if (label[a:b] == label[x]).all():
                    keep[k] = False
                    continue
                y = trie.lo[nodes[k]]
                while y < b and trie.length[y] == trie.depth[nodes[k]]:  # sets that end here
                    if y > x and label[y] != label[x] and (100 + percent) * overlap[k] >= percent * (n[x] + n[y]):
                        low, high = sorted((label[x], label[y]))
                        label[label == high] = low
                    y += 1
            nodes, overlap = nodes[keep], overlap[keep]
        mine[sets[x]] = False
    out = np.empty(m, label.dtype)
    out[order] = label
    return out


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """class_id, label: rows of each block (block, comp, class_id, n, grams, label) joined by trie."""

    def run(batches):
        frugal()
        for _, rows in _grouped(batches, 0):
            by: dict[int, list] = {}
            for r in rows:
                by.setdefault(r[1], []).append(r)
            ids, out = [], []
            for mine in by.values():
                if len(mine) == 1:
                    continue
                grams = [np.frombuffer(r[4], "<u8") for r in mine]
                label = trie_join(grams, np.array([r[3] for r in mine], np.int64), percent, np.array([r[5] for r in mine], np.int64))
                for r, v in zip(mine, label.tolist(), strict=True):
                    if v != r[5]:
                        ids.append(r[5])
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["u", "v"])

    cols = sets.select("block", "comp", "class_id", "n", "grams", "label")
    return cols.repartition("block").sortWithinPartitions("block", "comp", "class_id").mapInArrow(run, "u long, v long").distinct()


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has SMALL rows at most."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def similar(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every text.

    A text's set: its distinct n-grams of ``size`` words [^\\x20\\x09-\\x0D]+ with A-Z lowered; with fewer words the whole
    sequence as one; without words, or null, empty and linked with nothing. Texts link when 100 * overlap >= percent *
    union; component_id is the least doc_id that links reach. N-grams are told apart by 64-bit fingerprints, however the input
    is dealt. Rows are texts of their own, whatever their ids: repeated ids don't join their texts, and a null id is the least
    only of a group without others. Other columns aren't read; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select("doc_id", "text")
    n_parts = parts(slim)
    bits = min(20, max(TOP, (SHARES * n_parts - 1).bit_length()))
    shares = max(n_parts, min(1 << bits, 4 * n_parts))
    dealt = _deal(slim, size, bits).repartition(shares, "share").sortWithinPartitions("share")
    chunks = _count(dealt, bits).repartition(n_parts, "chunk").sortWithinPartitions("chunk")
    path = scratch(spark, "sets")
    _sets(chunks, percent, bits).write.option("compression", "zstd").parquet(path)
    sets = spark.read.schema(_SETS).parquet(path)
    alone = sets.where("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # Equal lists are equal sets, or at least similar ones; where they needn't be, each text is a class of its own.
    own = F.when(100 * F.col("shared") >= percent * (2 * F.col("n") - F.col("shared")), F.lit(None).cast("long")).otherwise(F.col("row"))
    some = sets.where("sig is not null").withColumn("own", own)
    classes = cut(some.groupBy("n", "shared", "sig", "own").agg(F.min("row").alias("class_id"), F.min("doc_id").alias("least")))
    heads = classes.select(F.col("class_id").alias("row"))
    first = cut(some.join(_small(heads), "row", "left_semi").select(F.col("row").alias("class_id"), "n", "shared", "grams"))
    comps = cut(components(_candidates(first, percent, max(LINK_SHARES, n_parts))))
    pieces = first.join(_small(comps.withColumnRenamed("node", "class_id").withColumnRenamed("root", "comp")), "class_id").withColumn("grams_n", F.octet_length("grams") / 8)
    pieces = cut(pieces.select("comp", "class_id", "n", "shared", "grams", "grams_n"))
    labelled = cut(classes.join(_small(_labels(pieces, percent, TASK)), "class_id", "left").withColumn("label", F.coalesce("label", "class_id")))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    label_of = labelled.join(_small(cut(ids)), "label").select("n", "shared", "sig", F.col("own").alias("o"), "component_id")
    same = [F.col("s.n") == F.col("l.n"), F.col("s.sig") == F.col("l.sig"), F.col("s.shared") == F.col("l.shared"), F.col("own").eqNullSafe(F.col("o"))]
    rest = some.select("doc_id", "n", "shared", "sig", "own").alias("s").join(_small(cut(label_of)).alias("l"), same)
    return alone.unionByName(rest.select("doc_id", F.col("s.n").alias("n_shingles"), "component_id"))


def _labels(pieces: DataFrame, percent: int, task: int) -> DataFrame:
    """class_id, label (least class of its true component) of pieces: comp, class_id, n, shared, grams, grams_n."""
    total = pieces.groupBy("comp").agg(F.sum("grams_n").alias("weight"))
    big = cut(total.where(F.col("weight") > task).withColumn("k", F.ceil(F.col("weight") * 2 / task).cast("int")))
    rows = pieces.withColumn("label", F.col("class_id"))
    if big.limit(1).count() == 0:
        links = _blocks(rows.withColumn("block", F.pmod(F.xxhash64("comp"), F.lit(_spread(pieces, task)))), percent)
        return cut(links.select(F.col("u").alias("class_id"), F.col("v").alias("label")))
    # Components over ``task`` n-grams: first blocks by hash, which find most copies; then, with the labels found, the groups of their prefixes' n-grams.
    small = rows.join(_small(big.select("comp")), "comp", "left_anti")
    large = rows.join(_small(big.select("comp", "k")), "comp").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("k")).cast("int"))
    links = cut(
        _blocks(small.withColumn("block", F.pmod(F.xxhash64("comp"), F.lit(_spread(pieces, task)))), percent)
        .unionByName(_blocks(large.withColumn("block", F.xxhash64("comp", "part")), percent))
    )
    roots = cut(components(links)).select(F.col("node").alias("class_id"), F.col("root").alias("found"))
    left = cut(large.join(_small(roots), "class_id", "left").withColumn("label", F.coalesce("found", "class_id")).drop("found", "k", "part"))
    links = cut(links.unionByName(_blocks(by_prefix(left, percent, task), percent)))
    return cut(components(links)).select(F.col("node").alias("class_id"), F.col("root").alias("label"))


def _spread(pieces: DataFrame, task: int) -> int:
    """Blocks that whole groups are dealt to, an eighth of ``task`` n-grams each on average."""
    return max(8, int((pieces.agg(F.sum("grams_n")).first()[0] or 0) // max(1, task // 8)) + 1)


def by_prefix(sets: DataFrame, percent: int, task: int) -> DataFrame:
    """sets (class_id, n, shared, grams, grams_n, label) once for each group that they are compared in: block, comp (the group's n-gram) and the same columns.

    Similar sets have an n-gram in both prefixes, so those of one n-gram are a group. N-grams with the same sets are one group;
    groups whose sets have one label already are left out. A group of over ``task`` n-grams is cut in parts, compared in pairs.
    """

    def explode(batches):
        for b in batches:
            gram, owner, label, weight = [], [], [], []
            for c, n, shared, grams, lab in zip(*(x.to_pylist() for x in b.columns), strict=True):
                g = prefix(grams, n, shared, percent)
                gram.append(g)
                for x, v in ((owner, c), (label, lab), (weight, len(grams) // 8)):
                    x.append(np.full(len(g), v, np.int64))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (gram, owner, label, weight)], names=["gram", "class_id", "label", "weight"])

    of = cut(sets.select("class_id", "n", "shared", "grams", "label").mapInArrow(explode, "gram long, class_id long, label long, weight long"))
    groups = of.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("class_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class_id")).alias("y"), F.sum("weight").alias("weight"), F.min("label").alias("a"), F.max("label").alias("b"))
    once = groups.where("a <> b").groupBy("m", "x", "y").agg(F.min("gram").alias("gram"), F.max("weight").alias("weight"))
    chosen = cut(once.select("gram", F.when(F.col("weight") > task, F.ceil(F.col("weight") * 2 / task)).otherwise(1).cast("int").alias("k"), "weight"))
    members = of.select("gram", "class_id").join(_small(chosen), "gram").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("k")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("k = 1 or other <> part")
    spread = max(8, int((chosen.agg(F.sum("weight")).first()[0] or 0) // max(1, task // 8)) + 1)
    block = F.when(F.col("k") == 1, F.pmod(F.xxhash64("gram"), F.lit(spread))).otherwise(F.xxhash64("gram", F.least("part", "other"), F.greatest("part", "other")))
    return sets.drop("comp").join(cut(members.select(block.alias("block"), F.col("gram").alias("comp"), "class_id")), "class_id")
