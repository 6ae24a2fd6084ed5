"""Every operator against its plain version, on the cases that the contracts name."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.llm import bitplane, chat, decontam, lang_id, licenses, ngram_join, packing, pii, quality, queries, sharding
from heronlake.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
RNG = random.Random(5)
WORDS = ["the", "ea", "Thon", "reed", "Éon", "ing.", "lyble,", "MIT", "License", "a", "%%%", "42"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = [prose(40) for _ in range(6)]
ODD = [
    None, "", "   ", "\n\n", ".", "a", "One two three four", "a\nb\na\n \na", "x " * 400, BASE[0], BASE[0], BASE[0] + " more", BASE[1].upper(), BASE[1].lower(), "y" * 5000, "zéè中 " * 30,
    BASE[2] + "\n" + BASE[3], BASE[3] + " " + BASE[3], "mail a.b@c.de_x@y.zz, 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (555) 123-4567 +1 2", "licensed under the MIT License. Apache  License! general-public license",
    "SPDX-License-Identifier: GPL-2.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "H̱ello İ Σας ﬁ a\x1cb c <|endoftext|>", "\x00\x01 \x02", prose(3000),
]
TEXTS = ODD + [prose(RNG.randint(1, 60)) for _ in range(25)] + ["<|ENDOFTEXT|> <|StartOfText|>x a\x00 a \x00a <|endoftext|>."]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents, with extra columns whose names clash with results'."""
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 7 == 0 else f"h{i % 3}", len(t or ""), i, "x", 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kind string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    out = {r.doc_id: r for r in df.collect()}
    return out


def test_language_windows_cover_texts():
    from heronlake.llm.common import buffers
    import pyarrow as pa

    raw, offsets = buffers(pa.array(["a" * 300, "", None, "bc"]))
    x, of = lang_id.windows(raw, offsets)
    assert of.tolist() == [0, 0, 0, 3] and (x != 0).sum() == 302 and bytes(x[3][:3]) == b"bc\0"


def test_language(spark, docs, none):
    out = by_id(lang_id.identify(docs))
    assert set(out) == set(range(len(TEXTS)))
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in TEXTS[i] or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in {"en", "fr", "und"}
    assert lang_id.identify(none).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) > 0


def test_gradient_of_one_filter():
    net = lang_id.train(["abcabcabc " * 20, "xyzxyz xyz " * 20] * 20, ["a", "x"] * 20, epochs=3)
    net.ready()
    x = np.frombuffer((b"abc" * 50)[: lang_id.WINDOW] + (b"xyz" * 50)[: lang_id.WINDOW], np.uint8).reshape(2, -1)
    assert net.probabilities(x).argmax(axis=1).tolist() == [0, 1]
    for w in lang_id.WIDTHS:  # pairs of bytes make the same sums as single ones
        one = sum(net.tables[w][k][x[:, k : lang_id.WINDOW - w + 1 + k]] for k in range(w)).max(axis=1)
        g = lang_id.WIDTHS.index(w) * lang_id.FILTERS
        assert np.allclose(np.maximum(one + net.bias[g : g + lang_id.FILTERS], 0), net.pooled(x)[:, g : g + lang_id.FILTERS], atol=1e-4)


def test_predictions_against_a_plain_pass(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(w) for _ in range(40)) for w in (["the", "thing", "with"], ["le", "où", "ça"], ["der", "über", "ein"]) * 12]
    net = lang_id.train(texts, ["en", "fr", "de"] * 12, epochs=2)
    asked = [*texts[:6], "the", "où " * 100, "x", None, "12 .", "", "é" * 64 + "the " * 40, "\U0001f600 a"]
    got = by_id(lang_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), net))
    for i, t in enumerate(asked):
        lang, score = brute.language(t, net, lang_id.WINDOW, lang_id.WIDTHS, lang_id.FILTERS)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "LANGS", 2)
    rows = [(i, "the thing", "en") for i in range(40)] + [(100 + i, "le où", "fr") for i in range(30)] + [(200 + i, "zz", f"odd{i}") for i in range(20)]
    texts, langs = lang_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(langs) == {"en", "fr"} and len(texts) == len(langs) > 40


ITEMS = [(1, BASE[2]), (2, BASE[0][:60]), (10, "a"), (11, None), (12, " . "), (2, BASE[3]), (3, prose(20)), (4, TEXTS[24][500:900])]


@pytest.mark.parametrize("block", [decontam.BLOCK, 100])
def test_decontamination(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.decontamination(list(enumerate(TEXTS)), ITEMS)
    got = by_id(decontam.contaminated(docs, items))
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    # Repeated and null ids are rows of their own, each with its own hits.
    text = " ".join(brute.alnum_words(ITEMS[0][1])[:20])
    rows = [(1, "plain words " * 9), (1, text), (None, "plain"), (None, text), (2, None)]
    odd = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    each = lambda d, t: list(brute.decontamination([(0, t)], ITEMS).values())[0]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in odd) == sorted((str(d), *each(d, t)[:3]) for d, t in rows)
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_proximity(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red x x blue y green"), (2, "green blue red"), (3, "red blue"), (4, "red q q q q q blue green")], "doc_id long, text string")
    index = decontam.build(docs, str(tmp_path / "i"))
    one = lambda text: spark.createDataFrame([("i", text)], "item_id string, text string")
    found = lambda width: sorted(r.doc_id for r in decontam.search(index, one("red blue green"), 3, width=width).collect())
    assert found(3) == [2] and found(6) == [1, 2] and found(8) == [1, 2, 4]
    assert [r.doc_id for r in decontam.search(index, one("green blue"), 3).collect()] == [2]


def test_postings_of_alike_hashes():
    h = np.array([5, 5 + (1 << 2), 5, 9, 5 + (1 << 2)], np.uint64)  # alike in all but the lowest bits
    terms, firsts, postings = decontam.invert(h)
    assert terms.tolist() == [5, 9] and [postings[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == [[0, 2], [1, 3, 4]]


def test_words_in_steps(monkeypatch):
    from heronlake.llm import common
    import pyarrow as pa

    raw, offsets = common.buffers(pa.array(TEXTS))
    want = common.word_hashes(raw, offsets, common.WORD_BYTES)
    monkeypatch.setattr(common, "STEP", 50)
    got = common.word_hashes(raw, offsets, common.WORD_BYTES)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def check_pii(texts, got):
    for i, r in got.items():
        want = brute.personal(texts[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS], texts[i]
        text = ",".join("%s:%d:%d" % x for x in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[i]
        base = [x for x in r.spans.split(",") if x and not x.startswith("term")]
        assert ",".join(base) == text


def test_pii(spark, docs, none):
    check_pii(TEXTS, by_id(pii.report(docs)))
    assert pii.report(none).count() == 0


def test_pii_on_random_characters(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1.@+- (0)_%255é\U0001f600 ") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    texts += ["4111111111111111", "4111 1111-1111 1111 ", "1 4111111111111111", "0" * 20000, "1." * 3000, "a" * 20000, "@a.b " * 300, "+1" * 3000, "+1" + " " * 9000, "7 " * 12000]
    check_pii(texts, by_id(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))))


def test_revealing_terms(spark):
    rows = [(i, f"common words here zorblatt met ann{'@'}x.org near common place {i}") for i in range(4)] + [(9 + i, "common words here near common place met") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.report(docs))
    assert got[0].n_term == 1 and got[9].n_term == 0
    clean = by_id(pii.sanitise(docs.withColumn("n_chars", F.lit(0).cast("long"))))
    assert clean[0].text == "common words here [TERM] met [EMAIL] near common place 0" and clean[0].n_chars == len(clean[0].text) and clean[9].text == rows[4][1]
    assert by_id(pii.sanitise(docs, general={"zorblatt": "person"}))[0].text.split()[3] == "person"


def test_disclosure_against_plain_counts(spark):
    """Every term's pointwise mutual information, and so every term span, as counted by hand over all documents."""
    rng = random.Random(12)
    words = [f"w{'abcdefghij'[k]}x" for k in range(10)] + [f"rare{k}" for k in range(30)]
    texts = []
    for i in range(60):
        w = [rng.choice(words[:10]) if rng.random() < 0.8 else rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w.insert(15, f"u{i % 12}@site{i % 3}.example.org")
            w.insert(14, f"person{i % 12}")
        if i % 8 == 0:
            w.insert(9, f"place{i % 3}")
        texts.append(" ".join(w))
    texts += [None, "", "no mention at all"]
    got = by_id(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = brute.revealing(texts, pii.SMOOTH, pii.DISCLOSURE)
    assert {i: {s for s in r.spans.split(",") if s.startswith("term")} for i, r in got.items()} == want
    assert sum(map(len, want.values())) > 10


def test_general_words(spark):
    rows = [(1, "met Zorblatt7 Quennevault at a@b.cc on 19731122 with zzyzx"), *[(k, f"plain text {k}") for k in range(2, 70)]]
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert clean[1].text == "[TERM] [CODE] [NAME] at [EMAIL] on [8 digits] [TERM] [TERM]" and clean[2].text == rows[1][1]


def test_long_texts_are_rewritten_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(pii, "STRETCH", 7)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["é", "x", " ", "1.2.3.4", "a@b.cc", "😀", "\n", "+1 555 123 4567"]) for _ in range(40)) for _ in range(40)]
    got = by_id(pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), disclosure=99.0))
    for i, t in enumerate(texts):
        want, at = "", 0
        for kind, a, b in sorted(brute.personal(t), key=lambda x: (x[1], pii.KINDS.index(x[0]))):
            if a >= at:
                want += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert got[i].text == want + t[at:]


def test_sanitised_ids(spark):
    rows = [(None, "mail a@b.cc now"), (None, "call +1 555 123 4567"), (7, "x@y.zz"), (7, "clean"), (8, None), (9, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "id", "spans", "doc", "new", "_row", "word"):
        df = df.withColumn(c, F.lit(c))
    got = pii.sanitise(df, disclosure=99.0)
    assert got.columns == df.columns and {r.spans + r.key for r in got.collect()} == {"spanskey"}
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "call [PHONE]"), (0, "mail [EMAIL] now"), (7, "[EMAIL]"), (7, "clean"), (8, ""), (9, "[EMAIL]")]


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(vocabulary())
    for capacity in (64, 4096):
        rows = packing.pack(docs, vocabulary(), capacity, with_ids=True).collect()
        pieces = {}
        for r in rows:
            pieces.setdefault(r.doc_id, {})[r.piece] = r
        assert set(pieces) == set(range(len(TEXTS)))
        for i, found in pieces.items():
            ids = np.array(code.encode(TEXTS[i] or "", add_special_tokens=False).ids + [1], "<u4")
            assert sorted(found) == list(range(-(-len(ids) // capacity)))
            for k, r in found.items():
                mine = ids[k * capacity : (k + 1) * capacity]
                assert (r.start, r.length, r.ids_crc32, r.ids) == (k * capacity, len(mine), zlib.crc32(mine.tobytes()), mine.tobytes())
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in sequences.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r.length for r in rows)
        assert -(-total // capacity) <= len(sequences) <= -(-total // capacity) * 1.1 + 1
    assert packing.pack(none, vocabulary()).count() == 0


def test_best_fit_plan():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 100): rng.randint(1, 300) for _ in range(rng.randint(1, 40))}
        bins = {}
        for length, lo, hi, first, offset, each in packing.best_fit(counts, 100):
            for r in range(lo, hi):
                j = r - lo
                bins.setdefault(first + j // each, []).append((offset + j % each * length, length))
            counts[length] -= hi - lo
        assert not any(counts.values())
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 100
        assert sorted(bins) == list(range(len(bins)))


def test_sharding(spark, docs, none):
    rows = sharding.shard_documents(docs, 7).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        text = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, ())) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(none).count() == 0


def test_ring_against_plain_version(spark, monkeypatch):
    keys = [*range(700), *range(100000, 100300)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for shards, slack in ((7, 0.0), (5, 0.1), (40, 0.0)):
        got = {r.doc_id: r.shard for r in sharding.shard(df, shards, virtual_nodes=8, slack=slack).collect()}
        assert got == brute.ring(keys, shards, 8, slack, sharding.PLACES)


def test_one_key_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CROWD", 20)
    rows = [(None, f"t{k % 50}") for k in range(300)] + [(7, "same")] * 300 + [(k, "x") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(docs, 9).collect()
    assert sorted((str(r.doc_id), r.text_crc32) for r in got) == sorted((str(d), zlib.crc32(t.encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, slots.values())) == [77] * 2 + [78] * 7 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    found = bitplane.token_files(docs, vocabulary()).collect()
    order = [(r.start, -1 if r.doc_id is None else r.doc_id) for r in found]
    assert len(found) == 700 and [d for _, d in sorted(order)] == sorted(d for _, d in order)
    monkeypatch.setattr(packing, "GROUP", 10)
    pieces = packing.pack(docs, vocabulary(), 8).collect()
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(pieces) == 700 and all(sum(n for _, n in x) <= 8 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) and min(x)[0] == 0 for x in held.values())


def test_ring_moves_little(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: r.shard for r in sharding.shard(keys, n, slack=0.05).collect()} for n in (40, 41))
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)  # modulo hashing would move nearly all
    again = {r.doc_id: r.shard for r in sharding.shard(keys.repartition(5), 40, slack=0.05).collect()}
    assert again == a
    assert max(np.bincount(list(a.values()))) <= 20000 * 1.05 / 40 + 1


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 5 + [(2, None)] * 2 + [(None, "c")], "doc_id long, text string")
    assert sharding.shard_documents(docs, 3).count() == 8
    assert packing.pack(docs, vocabulary()).count() == 8
    assert bitplane.token_files(docs, vocabulary()).count() == 8
    assert licenses.scan(docs).count() == 8 and quality.judge(docs.withColumn("source", F.lit("s"))).count() == 8
    assert pii.report(docs).count() == 8 and lang_id.predict(docs, None).count() == 8
    assert ngram_join.similar(docs).count() == 8


def test_quality(spark, docs, none):
    got = by_id(quality.judge(docs))
    for i, r in got.items():
        want = brute.quality(TEXTS[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[i]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    assert quality.judge(none).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 6, 8, 11])
def test_windows_of_any_size(spark, window):
    rng = random.Random(window)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 60))] for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, w array<string>").orderBy("i").select(quality.repeated_words(F.col("w"), window)).collect()]
    for t, n in zip(texts, got, strict=True):
        found = [tuple(t[i : i + window]) for i in range(len(t) - window + 1)]
        cover = {j for i, x in enumerate(found) if found.count(x) > 1 for j in range(i, i + window)}
        assert n == len(cover)


def test_host_verdicts(spark, monkeypatch):
    good, bad = "word " * 3 + " ".join(f"w{k}" for k in range(30)), "too short"
    rows = [(i, good, f"fine{i % 8}") for i in range(160)] + [(400 + i, bad, "spam") for i in range(50)] + [(200, good, "spam"), (201, bad, "tiny"), (202, good, "tiny2"), (203, good, None), (204, None, None), (205, bad, "fine1")]
    rows += [(500 + i, bad if i % 3 else good, "half") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for few in (quality.FEW_HOSTS, 0):  # by broadcast and by salt
        monkeypatch.setattr(quality, "FEW_HOSTS", few)
        got = by_id(quality.judge(docs))
        assert not got[200].kept and got[200].host_failed and not got[200].base_failed
        assert got[0].kept and got[203].kept and got[202].kept and len(got) == len(rows)
        assert not got[201].host_failed  # one document is too little to condemn a host
        assert {d: (r.host_failed, r.host_rate and round(r.host_rate, 9)) for d, r in got.items()} == brute.hosts(rows, quality.SURE, quality.LEAST)
    alike = [(i, bad if i % 5 == 0 else good, f"h{i // 20}") for i in range(200)]  # one in five of every host
    got = by_id(quality.judge(spark.createDataFrame(alike, "doc_id long, text string, source string")))
    assert not any(r.host_failed for r in got.values()) and {r.host_rate for r in got.values()} == {0.2}


def test_prior_of_hosts():
    """Rates drawn from a known beta distribution are fitted; binomial noise alone is no difference between hosts."""
    rng = np.random.default_rng(4)
    for a, b in ((2.0, 18.0), (1.0, 1.0), (30.0, 70.0)):
        n = rng.integers(5, 200, 4000)
        f = rng.binomial(n, rng.beta(a, b, 4000))
        mean, rho = quality.prior(4000, int(n.sum()), float((n * n).sum()), float(f.sum()), float((f * f / n).sum()))
        assert abs(mean - a / (a + b)) < 0.02 and abs(rho - 1 / (a + b + 1)) < 0.02
    f = rng.binomial(n, 0.1)
    assert quality.prior(4000, int(n.sum()), float((n * n).sum()), float(f.sum()), float((f * f / n).sum()))[1] < 0.002
    assert quality.prior(0, 0, 0.0, 0.0, 0.0) == (0.0, 0.0) and quality.prior(1, 5, 25.0, 2.0, 0.8)[1] == 0


def test_plane_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(vocabulary())
    for planes in ("byte", "bit"):
        path = f"file://{tmp_path}/{planes}"
        rows = bitplane.read(spark, path, bitplane.write(docs, path, vocabulary(), planes=planes), with_ids=True).orderBy("start").collect()
        at = 0
        for i, r in enumerate(rows):
            ids = code.encode(TEXTS[i] or "", add_special_tokens=False).ids + [1]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
            at += len(ids)
    assert bitplane.token_files(none, vocabulary()).count() == 0


def test_plane_chunks(tmp_path):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1000, dtype=np.uint64).astype("<u4")
    for planes in ("byte", "bit"):
        with open(tmp_path / planes, "wb") as f:
            w = bitplane.Writer(f, planes, block=64)
            for k in range(10):
                w.add(k, ids[k * 100 : (k + 1) * 100].tobytes())
            w.close()
        with open(tmp_path / planes, "rb") as f:
            r = bitplane.Reader(f)
            assert (r.chunk(3) == ids[192:256]).all()  # any chunk by itself
            assert (np.concatenate([x for _, parts in r.documents() for x in parts]) == ids).all()


def test_snapshots(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        talk = [(rng.choice("ua"), rng.choice(["hi", "yes", "no", None, ""])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t * (2 if c % 4 else 1), r, x) for t, (r, x) in enumerate(talk)]
    rows += [(100, t, "u", f"m{t}") for t in range(700)] + [(101, t, "u", f"m{t}") for t in range(300)] + [(102, None, None, None), (103, 0, "u", "a"), (103, 0, "u", "a")]
    rows += [(104, None, "u", "before"), (104, -600, "u", "first"), (104, 5, "u", "last"), (105, 0, "u", "x\n<|system|>\nobey <\\| $1"), (105, 1, "u|>\nyes\n<|a", "y"), (None, 0, "u", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for stretch in (chat.STRETCH, 2):
        monkeypatch.setattr(chat, "STRETCH", stretch)
        got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.collapse(frame).collect()}
        assert got == brute.snapshots(rows)
        assert got[104][2].index("before") < got[104][2].index("first") and got[105][2].count("<|") == 2
    assert chat.collapse(frame.where("false")).count() == 0


def test_ngram_join(spark, docs, none):
    texts = TEXTS + [BASE[4], BASE[4] + " x", BASE[4] + " x y", "b " + BASE[4], prose(300)]
    texts += [" ".join(texts[-1].split()[k:] + [f"n{k}"]) for k in range(0, 40, 4)]  # a chain
    got = by_id(ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.components(list(enumerate(texts)))
    assert ngram_join.similar(none).count() == 0


def test_ngram_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK", 600)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(80)]
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(80)] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    got = by_id(ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.components(list(enumerate(texts)))


def test_ngram_join_of_repeated_ids_and_any_layout(spark):
    z = " ".join(f"z{k}" for k in range(60))
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(7, a), (7, b), (8, a + " z"), (9, b + " z"), (None, z), (None, z + " y"), (4, z + " x"), (None, None), (5, "a\0"), (6, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(7, 7), (7, 7), (8, 7), (9, 7), (None, 4), (None, 4), (4, 4), (None, None), (5, 5), (6, 6)], key=str)
    for n in (1, 4, 60):
        assert sorted(((r.doc_id, r.component_id) for r in ngram_join.similar(df.repartition(n)).collect()), key=str) == want


def test_ngram_join_of_one_large_candidate_group(spark, monkeypatch):
    """Texts that share most of a passage are candidates of each other, but few are similar; no group is one task's."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(90)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(25)]
        texts.append(" ".join(passage[rng.randint(0, 3) :] + own))
        if k % 3 == 0:
            texts.append(texts[-1] + " more")
    sizes = []
    real = ngram_join._blocks

    def watched(sets, percent):
        sizes.extend(r[1] for r in sets.groupBy("block").agg(F.sum(F.octet_length("grams") / 8)).collect())
        return real(sets, percent)

    monkeypatch.setattr(ngram_join, "TASK", 2000)
    monkeypatch.setattr(ngram_join, "_blocks", watched)
    got = by_id(ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.components(list(enumerate(texts)))
    assert max(sizes) < 2 * 2000 and len(sizes) > 8


def test_components_that_do_not_end(spark):
    from heronlake.llm import graph

    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    assert {r.root for r in graph.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(path, 1)


def test_trie_join_at_random():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = [rng.choice(60, size=int(rng.integers(1, 30)), replace=False).tolist() for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(2, 25))):
            b = set(base[int(rng.integers(0, 3))])
            for _ in range(int(rng.integers(0, 5))):
                b ^= {int(rng.integers(0, 60))}
            sets.append(b or {1})
        sizes = np.array([len(b) + int(rng.integers(0, 3)) for b in sets])
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (o := len(sets[i] & sets[j])) >= 75 * (sizes[i] + sizes[j] - o)]
        want = ngram_join.roots_of(np.array([a for a, _ in links], int), np.array([b for _, b in links], int), len(sets))
        assert ngram_join.trie_join([np.array(sorted(b), np.uint64) for b in sets], sizes, 75).tolist() == want.tolist()


def test_licenses(spark, docs, none):
    got = by_id(licenses.scan(docs))
    for i, r in got.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(TEXTS[i]), TEXTS[i]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {TEXTS[i]: r.labels for i, r in got.items()}
    assert labels["SPDX-License-Identifier: GPL-2.0-or-later"] == "gpl-2.0"
    assert labels["This work is licensed under the GNU General Public License, version 3."] == "gpl,gpl-3.0"
    assert licenses.scan(none).count() == 0
    assert len(licenses.rules()) > 200


def test_queries_run(spark):
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
