"""Quality rules of documents, and of hosts through shrunk failure rates (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

WINDOW = 8
#: Document rules that hosts are judged by, as conditions on the counted columns.
RULES = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
#: Standard deviations of a host's own rate that it gets the benefit of; share of documents under which no host fails.
SURE, LEAST = 2.0, 0.3
#: Hosts by name up to so many are broadcast; more are joined by salted key.
FEW_HOSTS, SALTS = 100_000, 32


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the same list.

    Windows are hashed to 64 bits. Texts without a repeated hash, almost all, are done after one pass; in the others equal
    hashes are brought together by sorting, and a run of repeated windows that overlap counts its words once.
    """

    def cover(at: Column) -> Column:  # sorted starts of repeated windows
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(window)))
        return F.when(F.size(at) == 0, F.lit(0)).when(F.size(at) == 1, F.lit(window)).otherwise(F.aggregate(gaps, F.lit(window), lambda s, x: s + x))

    def starts(hashes: Column) -> Column:
        def twins(sorted_: Column) -> Column:
            n = F.size(sorted_)
            pairs = F.zip_with(F.slice(sorted_, 1, n - 1), F.slice(sorted_, 2, n - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
            return F.array_sort(F.array_distinct(F.flatten(pairs)))

        return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins)

    def pairs(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    def of(w: Column) -> Column:
        hashes, step = F.transform(w, lambda x: F.xxhash64(x)), 1
        while 2 * step <= window:  # windows of 2, 4, 8 words from two of half the size
            hashes, step = pairs(hashes, step), 2 * step
        if step < window:  # the rest overlaps
            hashes = pairs(hashes, window - step)
        return let(F.slice(hashes, F.lit(1), F.size(w) - window + 1), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), cover)))

    return F.when(F.size(found) < window + 1, F.lit(0)).otherwise(let(found, of))


def counted(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules use. Null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.col(host).alias("host"), text.alias("_t"), words(F.col("text")).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_l"))
    return base.select(
        "doc_id",
        "host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )


def prior(hosts: int, n: int, squares: float, failed: float, spread: float) -> tuple[float, float]:
    """(mean, overdispersion) of a beta-binomial fitted by moments: 0 where hosts differ no more than chance lets them.

    hosts and documents, the sum of n_h ** 2, of f_h (documents that fail) and of f_h ** 2 / n_h. The overdispersion rho of
    beta(a, b) is 1 / (a + b + 1); binomial noise alone is taken out: E[sum n_h (f_h / n_h - mean) ** 2] =
    mean (1 - mean) (hosts - 1 + rho (n - squares / n - hosts + 1)).
    """
    mean = failed / n if n else 0.0
    room, noise = mean * (1 - mean), n - squares / n - (hosts - 1) if n else 0.0
    if room <= 0 or noise <= 0:
        return mean, 0.0
    return mean, min(1.0, max(0.0, ((spread - failed * failed / n) / room - (hosts - 1)) / noise))


def host_rates(features: DataFrame, rules: dict[str, str] = RULES, sure: float = SURE, least: float = LEAST) -> DataFrame:
    """host, n_docs, and for each rule the shrunk rate of documents that fail it, and whether the host fails it.

    A host's rate has the posterior beta(a + f, b + n - f) under the prior fitted to all hosts: its mean is the shrunk rate,
    nearer to the common one the fewer documents the host has and the less hosts differ. The host fails where its rate, less
    ``sure`` standard deviations of the posterior, is over the prior's mean and one standard deviation of the prior, and no
    less than ``least`` of its documents fail. Where hosts are alike, all have the common rate and none fails.
    """
    fails = [F.sum(F.expr(f"cast({rule} as int)")).alias(f"f_{k}") for k, rule in rules.items()]
    hosts = cut(features.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails))
    sums = [F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("squares")]
    for k in rules:
        sums += [F.sum(f"f_{k}").alias(f"s_{k}"), F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / F.col("n_docs")).alias(f"q_{k}")]
    got = hosts.agg(*sums).first()
    out = [F.col("host"), F.col("n_docs")]
    for k in rules:
        mean, rho = prior(got["hosts"], got["n"] or 0, got["squares"] or 0.0, float(got[f"s_{k}"] or 0), float(got[f"q_{k}"] or 0))
        rate = (rho * F.col(f"f_{k}") + mean * (1 - rho)) / (rho * F.col("n_docs") + (1 - rho))
        doubt = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) * rho / (rho * F.col("n_docs") + 1))
        usual = mean + (mean * (1 - mean) * rho) ** 0.5
        out += [rate.alias(f"rate_{k}"), ((rate - sure * doubt > usual) & (rate >= least)).alias(f"fails_{k}")]
    return hosts.select(*out)


def judge(docs: DataFrame, host: str = "source", rules: dict[str, str] = RULES, sure: float = SURE, least: float = LEAST) -> DataFrame:
    """The counts, base_failed, kept, host_failed and host_rate, the host's worst shrunk rate: a row for each document.

    A host fails if it fails one rule (``host_rates``), and all its documents with it; documents without a host (null) have only
    their own rules, and no rate. Host verdicts are joined back by broadcast when there are FEW_HOSTS at most, else by host and
    salt, so that a host with a third of the rows is spread over SALTS groups. Null text counts as empty; equal and repeated
    rows count each for itself; other columns aren't read; no rows give no rows.
    """
    features = cut(counted(docs, host))
    rates = host_rates(features.where("host is not null"), rules, sure, least)
    worst = F.array_max(F.array(*[F.col(f"rate_{k}") for k in rules], F.lit(0.0)))
    any_ = F.array_contains(F.array(*[F.col(f"fails_{k}") for k in rules], F.lit(False)), True)
    verdict = cut(rates.select(F.col("host").alias("_h"), worst.alias("host_rate"), any_.alias("_failed")))
    if verdict.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        joined = features.join(F.broadcast(verdict), F.col("host") == F.col("_h"), "left")
    else:
        salted = features.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        copies = verdict.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, (F.col("host") == F.col("_h")) & (F.col("_s") == F.col("_z")), "left")
    base = F.expr(f"({RULES['short']}) or ({RULES['repeated']})")
    failed = F.coalesce("_failed", F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~failed).alias("kept"), failed.alias("host_failed"), "host_rate",
    )
