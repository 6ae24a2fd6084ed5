"""minhash_lsh against the Jaccard similarity of its queries with all texts."""

from __future__ import annotations

import re

from heronlake import queries


def test_pairs_of_documents(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[40 * i : 40 * i + 60]) for i in range(8)}
    texts |= {100 + i: texts[i] + " more" for i in range(4)} | {200 + i: texts[i].upper() for i in range(3)} | {300: "a b", 301: "A  b", 302: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {}
    for i, t in texts.items():
        if t is not None:
            w = re.split(r"\s+", t.lower())
            sets[i] = {" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}
    near = {}
    for a, b in ((a, b) for a in sets for b in sets if a % 100 == 0 and a != b):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 4 * both >= 3 * either:
            near[a, b] = (both, either)
    found = {(r.probe, r.key): (r.n_both, r.n_either) for r in queries.QUERIES["minhash_lsh"](spark, str(tmp_path)).collect()}
    assert found == near and {(0, 100), (0, 200), (100, 0), (300, 301)} <= set(near)
