"""Text analysis and BM25 scoring as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

# The words that the usual analyzer leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "do", "does", "for", "from",
    "had", "has", "have", "he", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no",
    "not", "of", "on", "or", "she", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "we", "were", "will", "with", "you",
)
# Ranges of characters that are indexed as pairs.
CJK = "\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}"
#: What parts words of lower-case text. ASCII is told apart by plain ranges, which are several times as fast as Unicode properties.
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F[^\\x00-\\x7F\\p{IsAlphabetic}\\p{N}]]+"


def tokenize(text: Column) -> Column:
    """Runs of letters and digits in lower case; of CJK runs each pair of neighbours, or the one character."""
    runs = F.filter(F.split(F.lower(text), NOT_ALNUM), lambda x: x != "")

    def pairs(run: Column) -> Column:
        n = F.length(run)
        two = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(~run.rlike(f"^[{CJK}]"), F.array(run)).when(n == 1, F.array(run)).otherwise(two)

    split = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.regexp_extract_all(r, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0)), pairs))))
    return F.when(text.rlike(f"[{CJK}]"), split).otherwise(runs)


def stem(word: Column) -> Column:
    """The plural rules: ies to y, else a last s goes unless it is us or ss; short words and others than ASCII stay."""
    cut = F.when(word.rlike("[^ae]ies$"), F.concat(F.left(word, F.length(word) - 3), F.lit("y")))
    cut = cut.when(word.rlike("s$") & ~word.rlike("[us]s$"), F.left(word, F.length(word) - 1)).otherwise(word)
    return F.when((F.length(word) <= 3) | word.rlike("[^\\x00-\\x7F]"), word).otherwise(cut)


def stem_word(word: str) -> str:
    """stem() of one word on the driver."""
    if len(word) <= 3 or not word.isascii():
        return word
    if word.endswith("ies") and word[-4] not in "ae":
        return word[:-3] + "y"
    return word[:-1] if word[-1] == "s" and word[-2] not in "us" else word


def forms(term: str) -> list[str]:
    """The words whose stem is a term: so a search compares words with these instead of stemming each word of a corpus."""
    return [w for w in dict.fromkeys([term, term + "s", term[:-1] + "ies"]) if stem_word(w) == term]


@dataclass(frozen=True)
class Analyzer:
    """tokenize, then leave out stop words, then stem."""

    stop: bool = True
    stems: bool = True

    @staticmethod
    def raw() -> Analyzer:
        return Analyzer(False, False)

    def words(self, text: Column) -> Column:
        """Before stemming."""
        out = tokenize(text)
        return F.filter(out, lambda x: ~x.isin(*STOP_WORDS)) if self.stop else out

    def analyze(self, text: Column) -> Column:
        return F.transform(self.words(text), stem) if self.stems else self.words(text)

    def forms(self, term: str) -> list[str]:
        return forms(term) if self.stems else [term]


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def validate(self) -> None:
        if not (0 <= self.k1 < float("inf")) or not (0 <= self.b <= 1):
            raise InvalidArgument("BM25: k1 is finite and not under 0, b is from 0 to 1")

    def term(self, tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
        norm = self.k1 * (1 - self.b + self.b * length / average)
        return F.when(tf > 0, idf(n, df) * tf * (self.k1 + 1) / (tf + norm)).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
