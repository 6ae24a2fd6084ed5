"""The pipeline against plain versions of its stages, on a small table of documents."""

from __future__ import annotations

import random
import re

import brute
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from heronlake.llm.tokens import vocabulary

RNG = random.Random(11)
ENGLISH, FRENCH = ["the", "of", "thing", "when", "there", "with", "ering", "wholly"], ["le", "éau", "être", "où", "leçon", "dans", "ça", "quoi"]


def prose(words, n):
    return " ".join(RNG.choice(words) + RNG.choice(["", "", "ing", "eau"]) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    items = [(k, prose(ENGLISH, 25)) for k in range(4)]
    texts = [(prose(ENGLISH, 60), "en") for _ in range(25)] + [(prose(FRENCH, 60), "fr") for _ in range(25)]
    texts += [(texts[3][0], "en"), (texts[3][0] + " more", "en"), (texts[4][0].upper(), "en"), (None, "en"), ("", None), ("... 12 !", "fr"), (prose(ENGLISH, 30) + " " + items[0][1], "en")]
    texts += [(prose(ENGLISH, 900) + " " + items[1][1] + " " + prose(ENGLISH, 900), "en")]  # a passage that is under a twentieth of its document
    texts += [(f"{prose(ENGLISH, 40)} a{k}.b@mail{k}.example.com and 10.0.0.{k} or +1 (555) 123-45{k:02d} {prose(ENGLISH, 5)}", None) for k in range(3)]
    rows = [(i, t, lang, f"s{i % 4}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows, items


def test_stages(spark, made):
    top, rows, items = made
    docs = spark.read.parquet(f"{top}/documents.parquet")
    held = {r[0]: r[1] for r in rows}
    columns = docs.columns

    def step(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, top)
        assert k == 4 or out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema)

    docs = step(0, docs)  # all with letters stay
    held = {d: t for d, t in held.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id: r.text for r in docs.collect()} == held
    docs = step(1, docs)
    groups = brute.components(list(held.items()))
    held = {d: t for d, t in held.items() if groups[d][1] == d}
    assert {r.doc_id: r.text for r in docs.collect()} == held and len(held) < 58
    docs = step(2, docs)
    bad = brute.decontamination(list(held.items()), items)
    held = {d: t for d, t in held.items() if not bad[d][1]}
    assert {r.doc_id: r.text for r in docs.collect()} == held and 56 not in held and 57 not in held and not bad[57][4] and len(held) > 45
    docs = step(3, docs)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(held)
    for d, r in got.items():
        want, at = "", 0
        for kind, a, b in sorted(brute.personal(held[d]), key=lambda x: x[1]):
            want, at = want + held[d][at:a] + f"[{kind.upper()}]", b
        want += held[d][at:]
        assert re.sub(r"\[TERM\]", "", r.text) == want or "[TERM]" in r.text
        assert not brute.personal(r.text) and r.n_chars == len(r.text)
    assert sum("[EMAIL]" in r.text and "[IP]" in r.text and "[PHONE]" in r.text for r in got.values()) == 3
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(vocabulary())
    pieces = step(4, docs).collect()
    assert sum(r.length for r in pieces) == sum(len(code.encode(r.text, add_special_tokens=False).ids) + 1 for r in got.values())


def test_run_agrees_with_stages(spark, made):
    top, _, _ = made
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, top)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(columns).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, top).select(columns).collect()))


def test_repeated_rows_and_no_rows(spark, made):
    top, rows, items = made
    docs = spark.read.parquet(f"{top}/documents.parquet")
    twice = docs.unionByName(docs)
    assert corpus_pipeline.STAGES[1][1](spark, twice, top).groupBy("doc_id").count().where("count > 1").count() == 0
    # Null ids, and one id for different texts: each row is a document of its own.
    texts = [(None, rows[0][1]), (None, rows[1][1]), (None, rows[1][1] + " more"), (7, rows[2][1]), (7, rows[3][1]), (8, rows[3][1]), (None, items[0][1] + " x"), (9, None), (9, "")]
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], docs.schema)
    left = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.STAGES[1][1](spark, odd, top).collect())
    assert len(left) == 7 and {(7, rows[2][1]), (7, rows[3][1]), (0, rows[0][1])} <= set(left) and (8, rows[3][1]) not in left
    clean = corpus_pipeline.STAGES[2][1](spark, odd, top).collect()
    assert len(clean) == 8 and all(items[0][1] not in (r.text or "") for r in clean)
    bare = corpus_pipeline.STAGES[0][1](spark, odd.withColumn("lang", F.lit(None).cast("string")), top)
    assert bare.count() == 7
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, top).count() == 0
