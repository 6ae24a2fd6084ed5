"""Personal data: base patterns, and terms that reveal what they protect (DataFrame operations only).

Protected entities are the values of base spans, and the groups that they belong to, which recur where values don't: the
domain of an email, the network of an address, the issuer of a card, the area of a phone number. A term near mentions of an
entity reveals it as far as knowing the term tells which entity is meant. With p(e) = df(e) / N, the share of documents that
mention e, and p(e | t) = (df(t, e) + s * p(e)) / (df(t) + s), the share among documents with t, drawn towards p(e) by s
documents that know nothing, the pointwise mutual information of t and e is log2(p(e | t) / p(e)), and e's own information
content is -log2(p(e)). df(t, e) counts documents with t near a mention of e, df(t) all documents with t anywhere. Where the
first reaches ``disclosure`` times the second, t is generalised or removed wherever it stands near e. No pair is too rare to
be scored: a word found once, beside a value found once, tells all there is to know of it, but for the smoothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .quality import let
from .spans import hits

KINDS = ("email", "ip", "card", "phone")
#: Starts are tried only where the leftmost match can begin, and runs aren't given back, so that each takes time in proportion to the text.
#: A card needs its 16 digits to match at all, as shorter chains are dropped anyway.
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])[0-9](?:[\\x20-]?[0-9]){15,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
TERM = "[\\p{L}\\p{N}]{3,}"
NOT_TERM = "[^\\p{L}\\p{N}]+"
#: Characters around a mention, and words of them on either side, that are near it.
NEAR_CHARS, NEAR_WORDS = 120, 6
#: Documents that draw a term's share towards the entity's own; share of an entity's information that a term may not reach.
SMOOTH, DISCLOSURE = 1.0, 0.8
SMALL, SMALL_BYTES = 500_000, 64 << 20
#: Characters of a text that are rewritten together.
STRETCH = 4096


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")

    def luhn(d: Column) -> Column:
        value = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (1 + (i - 1) % 2)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0)) % 10 == 0

    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(f"^(?:{part}(?:\\.|$)){{4}}$"))
        .when(kind == "card", F.when(F.length(digits).between(16, 19), let(digits, luhn)).otherwise(False))
        .otherwise(F.length(digits).between(8, 15))
    )


def mentions(docs: DataFrame) -> DataFrame:
    """_row, doc_id and, null in documents without any, kind, start, end, entities, left, right: base spans in code points. Null text is empty.

    entities: the value, and the group that it belongs to.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text.alias("_t"))
    t, none = F.col("_t"), F.array().cast("array<struct<kind:string,k:int,gap:int,hit:string,left:string,right:string>>")
    gates = {"email": t.contains("@"), "ip": t.rlike("[0-9]\\.[0-9]"), "card": t.rlike("[0-9][\\x20-]?[0-9][\\x20-]?[0-9]"), "phone": t.contains("+")}
    lists = [F.when(gates[k], hits(t, F.lit(PATTERNS[k]), NEAR_CHARS, kind=F.lit(k))).otherwise(none) for k in KINDS]
    rows = rows.select("doc_id", "_row", F.explode_outer(F.concat(*lists)).alias("x"))
    so_far = Window.partitionBy("_row", "x.kind").orderBy("x.k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("x.gap") + F.length("x.hit")).over(so_far)).withColumn("start", F.col("end") - F.length("x.hit"))
    ok = F.coalesce(_valid(F.col("x.kind"), F.col("x.hit")), F.lit(False)) & F.col("x.kind").isNotNull()
    value = F.when(F.col("x.kind").isin("card", "phone"), F.regexp_replace("x.hit", "[^0-9]", "")).otherwise(F.lower("x.hit"))
    group = (
        F.when(F.col("x.kind") == "email", F.regexp_extract(value, "@(.*)$", 1))
        .when(F.col("x.kind") == "ip", F.substring_index(value, ".", 2))
        .when(F.col("x.kind") == "card", F.left(value, F.lit(6)))
        .otherwise(F.left(value, F.lit(4)))
    )
    entities = F.array(F.concat_ws(":", F.col("x.kind"), value), F.concat_ws("::", F.col("x.kind"), group))
    return rows.select(
        "_row", "doc_id", *[F.when(ok, c).alias(n) for c, n in ((F.col("x.kind"), "kind"), (F.col("start"), "start"), (F.col("end"), "end"), (entities, "entities"), (F.col("x.left"), "left"), (F.col("x.right"), "right"))],
    )


def _near(found: DataFrame) -> DataFrame:
    """_row, entities, term, hit, start, end: whole words near mentions that are no part of a base span themselves."""
    kind = "array<struct<start:bigint,end:bigint,hit:string>>"

    def places(text: Column, at: Column) -> Column:
        """Words of a short text that begins at ``at``."""
        first = F.struct(F.lit(0).cast("int").alias("to"), F.array().cast(kind).alias("out"))

        def step(a, x):
            start = a.to + x.gap
            end = start + F.length(x.hit)
            return F.struct(end.alias("to"), F.concat(a.out, F.array(F.struct((at + start).alias("start"), (at + end).alias("end"), x.hit.alias("hit")))).cast(kind).alias("out"))

        return F.aggregate(hits(text, F.lit(TERM)), first, step, lambda a: a.out)

    real = found.where("kind is not null")
    before = places(F.col("left"), F.col("start") - F.length("left"))
    # The outermost word may have been cut off.
    before = let(before, lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - NEAR_WORDS + 1), F.lit(NEAR_WORDS)))
    before = F.when(F.length("left") == NEAR_CHARS, F.filter(before, lambda w: w.start > F.col("start") - NEAR_CHARS)).otherwise(before)
    after = let(places(F.col("right"), F.col("end")), lambda w: F.slice(w, 1, NEAR_WORDS))
    after = F.when(F.length("right") == NEAR_CHARS, F.filter(after, lambda w: w.end < F.col("end") + NEAR_CHARS)).otherwise(after)
    terms = real.select("_row", "entities", F.explode(F.concat(before, after)).alias("w")).select("_row", "entities", "w.hit", "w.start", "w.end", F.lit(False).alias("base"))
    spans = real.select("_row", F.lit(None).cast("array<string>").alias("entities"), F.lit(None).cast("string").alias("hit"), "start", "end", F.lit(True).alias("base"))
    order = Window.partitionBy("_row").orderBy("start", F.col("base").desc())
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    both = terms.unionByName(spans).withColumn("_e", F.max(F.when(F.col("base"), F.col("end"))).over(back)).withColumn("_s", F.min(F.when(F.col("base"), F.col("start"))).over(on))
    return both.where("not base and coalesce(_e <= start, true) and coalesce(_s >= end, true)").select("_row", "entities", F.lower("hit").alias("term"), "hit", "start", "end")


def _few(df: DataFrame, most: int = SMALL) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def disclosures(near: DataFrame, of_term: DataFrame, of_entity: DataFrame, n: int, smooth: float = SMOOTH) -> DataFrame:
    """entity, term, both, of_term, of_entity, pmi, content of every pair: near (_row, entities, term), of_term (term, of_term), of_entity (entity, of_entity), n documents."""
    pairs = near.select("_row", F.explode("entities").alias("entity"), "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    scored = pairs.join(of_term, "term").join(_few(of_entity), "entity")
    known = F.col("of_entity") / F.lit(float(max(n, 1)))
    given = (F.col("both") + smooth * known) / (F.col("of_term") + F.lit(smooth))
    return scored.withColumns({"pmi": F.log2(given / known), "content": -F.log2(known)})


def spans(docs: DataFrame, smooth: float = SMOOTH, disclosure: float = DISCLOSURE) -> DataFrame:
    """_row, doc_id, kind, start, end, hit for every base span and every revealing term (kind ``term``; hit: the word as it stands); null kind and places where a document has none.

    The term's side of the statistics counts all documents: their distinct words are counted, in part before
    the shuffle, and then meet the terms that stand near mentions. Equal documents count each for itself; no rows give no rows.
    """
    found = cut(mentions(docs))
    n = docs.select(F.lit(1)).count()
    near = cut(_near(found))
    terms = cut(near.select("term").distinct())
    words = F.array_distinct(F.split(F.lower("text"), NOT_TERM))
    seen = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    of_term = cut(seen.join(_few(terms), "term"))  # an inner join stays above the counting; a semi-join would be pushed below it
    of_entity = cut(found.where("kind is not null").select("_row", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")))
    scored = disclosures(near, of_term, of_entity, n, smooth)
    telling = cut(scored.where((F.col("content") > 0) & (F.col("pmi") >= disclosure * F.col("content"))).select("entity", "term"))
    placed = near.withColumn("entity", F.explode("entities"))
    bad = placed.join(_few(telling), ["entity", "term"], "left_semi").select("_row", F.lit("term").alias("kind"), "start", "end", "hit").distinct()
    ids = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"))
    base = found.select("_row", "doc_id", "kind", "start", "end", F.lit(None).cast("string").alias("hit"))
    return base.unionByName(bad.join(ids, "_row").select(base.columns))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), kind)


def report(docs: DataFrame, smooth: float = SMOOTH, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: a row for each document.

    Null text is empty; rows with one id, or none, are told apart; columns other than doc_id and text aren't read; equal places
    of one kind are one span. No rows give no rows.
    """
    item = F.when(F.col("kind").isNotNull(), F.struct(_rank(F.col("kind")).alias("r"), "start", F.concat_ws(":", "kind", "start", "end").alias("s")))
    rows = spans(docs, smooth, disclosure).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*KINDS, "term")], F.array_sort(F.collect_list(item)).alias("all")
    )
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.s), ",")
    base = F.filter("all", lambda x: x.r <= len(KINDS))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_term")


def _general(hit: Column, general: dict[str, str] | None) -> Column:
    """What stands for a revealing term: ``general``'s word for it, else its class by how it is written, least telling last."""
    known = F.create_map(*[F.lit(x) for kv in (general or {"": ""}).items() for x in kv])
    by_form = (
        F.when(hit.rlike("^\\p{N}+$"), F.concat(F.lit("["), F.length(hit), F.lit(" digits]")))
        .when(hit.rlike("\\p{N}"), F.lit("[CODE]"))
        .when(hit.rlike("^\\p{Lu}"), F.lit("[NAME]"))
        .otherwise(F.lit("[TERM]"))
    )
    return F.coalesce(known[F.lower(hit)], by_form)


def _rewritten(text: Column, found: Column) -> Column:
    """text with each of the spans (start, end, word; in order, apart from each other) replaced, a stretch at a time, so that work grows with the text."""

    def stretch(t: Column, i: Column) -> Column:
        at = i * STRETCH
        word = lambda x: F.when(x.start >= at, x.word).otherwise("")
        cut_out = lambda a, b: F.substring(t, (a - at + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

        def of(mine: Column) -> Column:
            done = lambda j: F.greatest(at, F.coalesce(F.get(mine, j - 1).end, at))
            parts = F.transform(mine, lambda x, j: F.concat(cut_out(done(j), x.start), word(x)))
            return F.when(F.size(mine) == 0, t).otherwise(F.concat(F.array_join(parts, ""), cut_out(done(F.size(mine)), at + STRETCH)))

        return let(F.filter(found, lambda x: (x.start < at + STRETCH) & (x.end > at)), of)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), stretch), "")


def sanitise(docs: DataFrame, smooth: float = SMOOTH, disclosure: float = DISCLOSURE, general: dict[str, str] | None = None) -> DataFrame:
    """docs with texts in which base spans are [EMAIL], [IP], [CARD] or [PHONE], and revealing terms are generalised: to
    ``general``'s word for them, to the number of their digits, to [CODE] or [NAME] by their form, others to [TERM]. Spans
    that overlap become one, named by the first.

    Changes are matched by two 64-bit hashes of the text, so null or repeated ids do no harm and equal texts are changed alike. They
    are broadcast when they are SMALL rows of SMALL_BYTES at most, else joined by a shuffle. All columns of docs stay, whatever their
    names; n_chars, where there is one, follows the text; null and empty texts stay; no rows give no rows.
    """
    key = F.concat_ws(":", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")))
    all_ = spans(docs.select(key.alias("doc_id"), "text"), smooth, disclosure).where("kind is not null")
    word = F.when(F.col("kind") == "term", _general(F.col("hit"), general)).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    order = Window.partitionBy("_row").orderBy("start", _rank(F.col("kind")))
    apart = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = all_.select("_row", "doc_id", "start", "end", word.alias("word"), _rank(F.col("kind")).alias("rank"), apart.cast("int").alias("apart"))
    rows = rows.withColumn("group", F.sum("apart").over(Window.partitionBy("_row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("_row", "group").agg(F.first("doc_id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("word", F.struct("start", "rank")).alias("word"))
    lists = whole.groupBy("_row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("spans"))
    lists = cut(lists.select("id", "spans").dropDuplicates(["id"]))
    size = lists.agg(F.count(F.lit(1)), F.sum(F.size("spans") * 48)).first()
    side = F.broadcast(lists) if size[0] <= SMALL and (size[1] or 0) <= SMALL_BYTES else lists
    joined = docs.select(key.alias("key"), F.struct("*").alias("doc")).join(side, F.col("key") == F.col("id"), "left")
    of = {c: F.col("doc").getField(c) for c in docs.columns}
    changed = F.col("spans").isNotNull()
    new = joined.select("doc", "spans", F.when(changed, _rewritten(of["text"], F.col("spans"))).otherwise(of["text"]).alias("new"))
    put = {"text": F.col("new"), "n_chars": F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(of["n_chars"]) if "n_chars" in of else None}
    return new.select(*[put[c].alias(c) if c in put else v.alias(c) for c, v in of.items()])
