"""Regex matches with their places, from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import let


def hits(text: Column, pattern: Column, around: int = 0, **tags: Column) -> Column:
    """Array of struct(tags, k, gap, hit): the k-th leftmost non-overlapping match and the length of the text between it and the one before.

    split() and regexp_extract_all() run over the same matches, so gaps and hits in turn make up the text, and a match starts
    where the lengths so far add up. The pattern must not match the empty string. With ``around``: also so many characters
    before and after at most, up to the next match (left, right).
    """

    def rows(gaps: Column) -> Column:
        def row(x, k):
            more = [F.right(x["gap"], F.lit(around)).alias("left"), F.left(F.get(gaps, k + 1), F.lit(around)).alias("right")] if around else []
            return F.struct(*[v.alias(t) for t, v in tags.items()], k.alias("k"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), *more)

        found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
        return F.filter(F.transform(found, row), lambda x: x.hit.isNotNull())

    return let(F.split(text, pattern, -1), rows)
