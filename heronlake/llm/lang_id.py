"""Language identification by a byte convolutional network, trained and run in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, ship, slices

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: Labelled documents of each language that the network is fitted on, about; characters taken of each, from anywhere in it. Passes over them.
SAMPLE, STRETCH, EPOCHS = 1500, 512, 6
#: Labels that are learned at most, the most frequent ones: wrong labels may be without number.
LANGS = 256
#: Windows that are run at once.
BATCH = 256
UNDETERMINED = "und"


@dataclass
class Network:
    """tables[width][k]: what byte value b at the k-th place of a filter adds to each filter (256 x FILTERS)."""

    langs: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    pairs: dict = field(default_factory=dict)

    def ready(self) -> None:
        """Tables of byte pairs, so that a filter takes half the look-ups."""
        for w, t in self.tables.items():
            self.pairs[w] = [(k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(1 << 16, -1)) for k in range(0, w - 1, 2)]

    def __getstate__(self):
        return self.__dict__ | {"pairs": {}}

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(windows, widths * FILTERS): the maximum of each filter over each window, not under 0."""
        pair = x[:, :-1].astype(np.int64) * 256 + x[:, 1:]
        out = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            total = None
            for k, t in self.pairs[w]:
                part = np.take(t, pair[:, k : k + n], axis=0, mode="clip")
                total = part if total is None else np.add(total, part, out=total)
            if w % 2:
                total += np.take(self.tables[w][w - 1], x[:, w - 1 : w - 1 + n], axis=0, mode="clip")
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(x) @ self.dense + self.offset)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, text of each window): whole texts in windows side by side, the last filled up with 0."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + nth * WINDOW
    left = np.minimum(size[text] - nth * WINDOW, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    x = raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else np.zeros(at.shape, np.uint8)
    short = np.flatnonzero(left < WINDOW)
    x[short] = np.where(np.arange(WINDOW) < left[short, None], x[short], 0)
    return x, text


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network | None:
    """Fits a network to labelled stretches by Adam on the cross entropy; None without any. One in five windows is cut short, as ends of texts are."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    raw, offsets = buffers(pa.array(texts, pa.string()))
    x, of = windows(raw, offsets)
    y = np.array([names.index(v) for v in langs])[of]
    cut = np.flatnonzero(rng.random(len(x)) < 0.2)
    x[cut] = np.where(np.arange(WINDOW) < rng.integers(12, WINDOW, len(cut))[:, None], x[cut], 0)
    net = Network(
        names,
        {w: rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    params = [*net.tables.values(), net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            b, t = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
            rows = np.arange(len(b))
            peaks, values = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                out = np.take(net.tables[w][0], b[:, :n], axis=0)
                for k in range(1, w):
                    out += np.take(net.tables[w][k], b[:, k : k + n], axis=0)
                peaks.append(out.argmax(axis=1))
                values.append(np.take_along_axis(out, peaks[-1][:, None], axis=1)[:, 0])
            hidden = np.maximum(np.concatenate(values, axis=1) + net.bias, 0)
            grad = softmax(hidden @ net.dense + net.offset)
            grad[rows, t] -= 1
            grad /= len(b)
            back = (grad @ net.dense.T) * (hidden > 0)
            grads = []
            for g, w in enumerate(WIDTHS):
                mine, to = back[:, g * FILTERS : (g + 1) * FILTERS].ravel(), []
                for k in range(w):
                    at = b[rows[:, None], peaks[g] + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                    to.append(np.bincount(at.ravel(), mine, 256 * FILTERS).reshape(256, FILTERS))
                grads.append(np.stack(to).astype(np.float32))
            grads += [back.sum(axis=0), hidden.T @ grad, grad.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def held_out(doc_id):
    """Column: whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[str]]:
    """(stretches, langs) of about ``size`` labelled documents of each language that may be learned from.

    Chosen by the hash of doc_id, so the choice doesn't depend on the files' order; the driver gets size * STRETCH characters
    for each language, and LANGS bounds the languages. Null texts and those without a letter are drawn like others, and then left out.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, size / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("doc_id", F.lit("start")), room.cast("long")) + 1).cast("int")
    drawn = known.where(F.coalesce(draw <= share[F.col("lang")], F.lit(False))).where(F.col("text").rlike("\\p{L}"))
    rows = drawn.select("doc_id", "lang", F.col("text").substr(start, F.lit(STRETCH)).alias("text")).collect()
    rows = sorted((r.lang, r.doc_id, r.text) for r in rows)
    return [r[2] for r in rows], [r[0] for r in rows]


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for whole texts. score: the mean probability of the language over the text's windows.

    Null texts and those without a letter are ``und`` with score 0, as is everything without a network. Of equal languages the first by
    name wins. Rows are independent of each other, repeated ones and those without an id included; other columns aren't read.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"))

    def run(batches):
        if net:
            net.ready()
        for b in slices(batches):
            raw, offsets = buffers(b.column(1))
            n = b.num_rows
            lang, score = [UNDETERMINED] * n, np.zeros(n)
            if net and len(raw):
                total = np.zeros((n, len(net.langs)))
                i = 0
                while i < n:  # documents whose windows fit in some megabytes, a longer one by parts
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
                    for a in range(offsets[i], max(offsets[j], offsets[i] + 1), 1 << 22):
                        e = min(a + (1 << 22), offsets[j])
                        x, of = windows(raw[a:e], np.clip(offsets[i : j + 1], a, e) - a)
                        for k in range(0, len(x), BATCH):
                            p = net.probabilities(x[k : k + BATCH])
                            np.add.at(total, i + of[k : k + BATCH], p)
                    i = j
                count = total.sum(axis=1)
                best = total.argmax(axis=1)
                some = count > 0
                score[some] = np.clip(total[some, best[some]] / count[some], 0, 1)
                lang = [net.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trains on the documents' own labels and predicts all of them.

    A row for each row, none of none; the cases of ``predict``; a null doc_id isn't held out, and isn't learned from.
    """
    net = train(*sample(docs, size))
    out = predict(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
