"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bitplane, chat, decontam, lang_id, licenses, ngram_join, packing, pii, quality, sharding
from .common import table
from .tokens import vocabulary


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13, 20)
    return out.drop("items", "spans")


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 4096)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op7_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_files(table(spark, sf_dir, "documents"), vocabulary())


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.collapse(table(spark, sf_dir, "conversations"))
    return out.withColumn("rendered_sha256", F.sha2("rendered", 256))


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), 5, 75)


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    found = F.transform("detections", lambda x: F.concat_ws(":", x.label, x.start, x.end))
    return out.withColumn("detections", F.array_join(found, ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_byte_network, op2_positional_index, op3_disclosure, op4_best_fit_packing, op5_ring_shards, op6_host_rules,
            op7_plane_files, op8_snapshot_collapse, op9_prefix_tree_join, op10_license_rules,
        )
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_OP2 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM bw) ks, unnest(range(1, greatest(len(w) - k + 2, 1))) t(i)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + k)) u(p) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)"""


def _op6() -> str:
    rules = quality.RULES
    fails = ", ".join(f"count(*) FILTER ({r})::DOUBLE AS f_{k}" for k, r in rules.items())
    means = ", ".join(f"sum(f_{k}) / sum(n) AS m_{k}, sum(f_{k} * f_{k} / n) - sum(f_{k}) * sum(f_{k}) / sum(n) AS v_{k}" for k in rules)
    rhos = ", ".join(f"CASE WHEN m_{k} * (1 - m_{k}) > 0 AND noise > 0 THEN least(1, greatest(0, (v_{k} / (m_{k} * (1 - m_{k})) - (hosts - 1)) / noise)) ELSE 0 END::DOUBLE AS o_{k}" for k in rules)
    rate = ", ".join(f"(o_{k} * f_{k} + m_{k} * (1 - o_{k})) / (o_{k} * n + 1 - o_{k}) AS r_{k}" for k in rules)
    failed = " OR ".join(f"(r_{k} - {quality.SURE} * sqrt(greatest(r_{k} * (1 - r_{k}), 0) * o_{k} / (o_{k} * n + 1)) > m_{k} + sqrt(m_{k} * (1 - m_{k}) * o_{k}) AND r_{k} >= {quality.LEAST})" for k in rules)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_SPACED.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 6, 1))) u(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) x, unnest(range(i, i + 8)) u(p) WHERE c > 1 GROUP BY doc_id),
c AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, {fails} FROM c WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT {means}, count(*)::DOUBLE AS hosts, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS noise FROM h), k AS (SELECT *, {rhos} FROM m),
q AS (SELECT *, {rate} FROM h, k),
v AS (SELECT source, greatest({", ".join(f"r_{k}" for k in rules)}, 0) AS host_rate, {failed} AS host_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(host_failed, false) AS kept, coalesce(host_failed, false) AS host_failed, round(host_rate, 6) AS host_rate
FROM c LEFT JOIN v USING (source)"""


_OP8 = """
WITH t AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM conversations GROUP BY conv_id),
u AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM t GROUP BY l),
p AS (SELECT DISTINCT l[1:i] AS l FROM u, unnest(range(1, len(l))) x(i)),
k AS (SELECT * FROM u WHERE l NOT IN (SELECT l FROM p)),
s AS (SELECT conv_id, len(l) AS n_turns, copies, array_to_string(list_transform(l, lambda y: '<|' || regexp_replace(regexp_replace(coalesce(y.r, ''), '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '\\|(\\\\*)>\\n', '|\\1\\\\>' || chr(10), 'g') || '|>' || chr(10) || regexp_replace(coalesce(y.x, ''), '<(\\\\*)\\|', '<\\1\\\\|', 'g') || chr(10)), '') AS rendered FROM k)
SELECT *, sha256(rendered) AS rendered_sha256 FROM s"""

_OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.y AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others' rows come from a trained network (1), statistics and spans (3, 10), plans (4, 5) or a tokenizer (4, 7); tests compare them with plain versions."""
    return {"op2_positional_index": _OP2, "op6_host_rules": _op6(), "op8_snapshot_collapse": _OP8, "op9_prefix_tree_join": _OP9}
