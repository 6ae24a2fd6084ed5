"""Token ids of whole texts through the tokenizers library, with one encoding for each distinct word."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import LENGTH, buffers, mixed, powers

#: Words that are encoded in one call; text bytes that are looked up together.
BLOCK, GROUP = 256, 1 << 20
#: Words and ids that a process keeps at most; with more it starts anew. Slots of the hash table of words.
WORDS, POOL, SLOTS = 1_000_000, 8_000_000, 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """ids of a vocabulary that lowers letters and drops white space (word_bpe_49k.json).

    None of its pre-tokenizer's pieces crosses white space, and a full stop or comma between an ASCII letter or digit and
    white space is a piece of its own. So texts are cut there, A-Z are lowered, and a text's ids are its words' ids in a row.
    A-Z stay where a text may hold combining marks, with which a letter in another case may compose differently, or an added token in any case.
    Words are looked up by 64-bit hash in a table of numpy arrays; only new ones go through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in ("\x01", "\x02")]
        #: A character with an id of its own, which stands between the words of a block.
        self.mark = marks[0][0] if len(marks[0]) == 1 and marks[0] != marks[1] else None
        #: Added tokens as they read in lower case: the library finds them in texts as they are, before it lowers letters.
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content.encode().lower() != t.content.encode().upper()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.first, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, "<u4"), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it is new."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.place[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        at = slot[left]
        while len(left):
            at = (at + 1) & (SLOTS - 1)
            got = self.place[at]
            out[left] = got
            on = (got >= 0) & (self.keys[at] != h[left])
            left, at = left[on], at[on]
        return out

    def _add(self, h: np.ndarray, places: np.ndarray) -> None:
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(h):
            free = self.place[slot] < 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.place[slot[one]] = h[one], places[one]
            rest = np.ones(len(h), bool)
            rest[one] = False
            h, places, slot = h[rest], places[rest], (slot[rest] + 1) & (SLOTS - 1)

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        plain = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")
        if self.mark is None:
            return [plain(w) for w in words]
        out: list[np.ndarray] = []
        blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" \x01 ".join(x) for x in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(block) - 1:  # a word holds the mark
                out += [plain(w) for w in block]
            else:
                at, to = [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)]
                out += [ids[i:j] for i, j in zip(at, to, strict=True)]
        return out

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        ids = self._ids(words)
        sizes = np.array([len(x) for x in ids], np.int32)
        total, n = int(sizes.sum()), len(words)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
        while self.n + n > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.first, self.size))
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.size[self.n : self.n + n] = sizes
        self.first[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self._add(h, np.arange(self.n, self.n + n, dtype=np.int32))
        self.n, self.used = self.n + n, self.used + total

    def encode_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the end) of UTF-8 bytes."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        b = _LOWER[raw]
        if ((raw == 0xCC) | (raw == 0xCD)).any() or any(x in low for low in [b.tobytes()] for x in self.added):
            b = raw
        word = ~_SPACE[b]
        first = np.zeros(n + 1, bool)  # a text begins
        first[offsets[:-1]] = True
        before, after = np.zeros(n, bool), np.ones(n, bool)
        before[1:] = word[:-1] & ~first[1:n]
        after[:-1] = ~word[1:] | first[1:n]
        sign = ((b == 46) | (b == 44)) & after & before
        sign[1:] &= _ALNUM[b[:-1]]
        start = (word & ~before) | sign
        after[:-1] |= sign[1:]
        begin, end = np.flatnonzero(start), np.flatnonzero(word & after) + 1
        up, down = powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(b * up[:n], out=total[1:])
        h = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * LENGTH)
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(h[new], return_index=True)
            if self.n + len(fresh) > min(WORDS, SLOTS // 2) or self.used > POOL:
                self._clear()
                fresh, where = np.unique(h, return_index=True)
                new = np.arange(len(h))
            i = new[where]
            data = b.tobytes()
            self._learn(fresh, [data[x:y].decode() for x, y in zip(begin[i].tolist(), end[i].tolist(), strict=True)])
            at[new] = self._find(h[new])
        sizes = self.size[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, offsets)]

    def encode_many(self, column: pa.Array) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; none for null."""
        raw, offsets = buffers(column)
        out: list[bytes] = []
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
            if offsets[j] - offsets[i] > GROUP:
                out.append(self._long(raw[offsets[i] : offsets[j]]))
            else:
                ids, at = self.encode_bytes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                data, at = ids.tobytes(), (at * 4).tolist()
                out += [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            i = j
        return out

    def _long(self, raw: np.ndarray) -> bytes:
        """A very long text, by stretches that begin at white space."""
        cuts, i = [0], GROUP
        while i < len(raw):
            space = np.flatnonzero(_SPACE[raw[i : i + GROUP]])
            if len(space):
                cuts.append(i + int(space[0]))
            i += GROUP
        cuts.append(len(raw))
        return b"".join(self.encode_bytes(raw[a:b], np.array([0, b - a]))[0].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def encode(self, text: str | None) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0]


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
