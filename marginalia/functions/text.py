"""Text functions as Column expressions: characters, tokens, terms, n-grams and Unicode-aware trimming."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: scripts that are counted and searched by character
CJK_RANGES = (
    (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x303F), (0x3040, 0x30FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
    (0xFF66, 0xFF9D), (0xAC00, 0xD7A3), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0x2CEB0, 0x2EBEF),
)
PUNCTUATION_RANGE = (0x3000, 0x303F)
ITERATION_MARK = 0x3005
KATAKANA, HIRAGANA = (0x30A1, 0x30F6), (0x3041, 0x3096)
LONG_RUN = 40


def char_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


_WORDY = tuple(r for r in CJK_RANGES if r != PUNCTUATION_RANGE)
CJK = char_class(CJK_RANGES)
CJK_LETTERS = char_class(_WORDY)
CJK_WORD = CJK_LETTERS + f"\\x{{{ITERATION_MARK:X}}}"
CJK_WORD_RANGES = (*_WORDY, (ITERATION_MARK, ITERATION_MARK))
WORD = "[A-Za-z0-9_]+"
NEGATED = rf"(?<![A-Za-z0-9_])(?<![{CJK_LETTERS}])-([A-Za-z0-9_]+|[{CJK}]+)"
# fixed values: a sentence ends after these marks, or after a full stop that white space follows
SENTENCE_END = r"(?<=[。．！？!?\n；])|(?<=\.)(?=\s)"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))



def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip(c: Column) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def lines(c: Column) -> Column:
    """Lines at any Unicode line break; a break at the end opens no line."""
    every = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)


def one_line(c: Column) -> Column:
    return F.array_join(lines(c), " ")


def token_estimate(c: Column) -> Column:
    """One token a CJK character and word; a word beyond 40 letters costs one more for every 4 begun."""
    runs = matches(c, f"[A-Za-z0-9_]{{{LONG_RUN + 1},}}")
    extra = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.floor((F.length(r) - LONG_RUN + 3) / 4))
    return (F.regexp_count(c, F.lit(f"[{CJK}]")) + F.regexp_count(c, F.lit(WORD)) + extra).cast("long")


def query_terms(c: Column) -> Column:
    """ASCII words, then runs of CJK letters."""
    return F.concat(matches(c, WORD), matches(c, f"[{CJK_WORD}]+"))


def negated_terms(c: Column) -> Column:
    """Terms that a leading minus excludes, in small letters."""
    return F.transform(matches(c, NEGATED, 1), F.lower)


def without_negated(c: Column) -> Column:
    return strip(F.regexp_replace(c, NEGATED, ""))


def kana_swap(c: Column) -> Column:
    """Katakana to hiragana and back."""
    kata = "".join(map(chr, range(KATAKANA[0], KATAKANA[1] + 1)))
    hira = "".join(map(chr, range(HIRAGANA[0], HIRAGANA[1] + 1)))
    return F.translate(c, kata + hira, hira + kata)


def grams(c: Column, n: int) -> Column:
    """Character n-grams in order; none if the text is shorter."""
    chars = F.split(c, "")
    every = chars
    for k in range(2, n + 1):  # characters are zipped, since a substring walks the text up to its place
        every = F.zip_with(every, F.slice(chars, k, F.length(c)), lambda a, b: F.concat(a, b))
    return F.when(F.length(c) >= n, F.slice(every, 1, F.length(c) - (n - 1))).otherwise(F.array().cast("array<string>"))


def starts_cjk(c: Column) -> Column:
    return c.rlike(f"^[{CJK}]")


def phrases(c: Column) -> Column:
    """What the index is asked for: words of 3 letters or more, and the trigrams of CJK runs in both kana."""

    def of(t: Column) -> Column:
        swapped = kana_swap(t)
        both = F.concat(grams(t, 3), F.when(swapped != t, grams(swapped, 3)).otherwise(F.array().cast("array<string>")))
        return F.when(F.length(t) < 3, F.array().cast("array<string>")).when(starts_cjk(t), both).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(query_terms(c), of)))


def needles(c: Column) -> Column:
    """What a substring scan looks for: CJK bigrams (or a lone character) and words of 2 letters or more."""

    def of(t: Column) -> Column:
        none = F.array().cast("array<string>")
        cjk = F.when(F.length(t) >= 2, grams(t, 2)).otherwise(F.array(t))
        return F.when(starts_cjk(t), cjk).when(F.length(t) >= 2, F.array(t)).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(query_terms(c), of)))


def quoted(c: Column) -> Column:
    """A pattern that matches a text literally."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def count_overlapping(text: Column, term: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit("(?="), quoted(term), F.lit(")")))


def count_apart(text: Column, term: Column) -> Column:
    """Counted in bytes, which are known without a walk through the text."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))) / F.octet_length(term)).cast("int")


def bigram_set(c: Column) -> Column:
    return F.array_distinct(grams(c, 2))


def squeezed(c: Column) -> Column:
    """Small letters without any white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


# fixed values: words that open a question in English, and how one ends in Japanese
QUESTION_WORDS = (
    "what", "how", "why", "when", "where", "who", "which", "does", "is", "are", "was", "were", "will", "would", "could", "should", "can",
)
QUESTION_ENDINGS = ("か", "ください", "でしょう")


def looks_like_question(normal: Column) -> Column:
    """Whether a text (already NFKC) asks: a question mark, a question's ending or its first word."""
    base = F.regexp_replace(normal, "[。.!?]+$", "")
    first = F.element_at(F.split(F.lower(F.element_at(F.split(strip(normal), r"(?U)\s+"), 1)), "'"), 1)
    ends = F.lit(False)
    for e in QUESTION_ENDINGS:
        ends = ends | base.endswith(e)
    return normal.contains("?") | ends | F.coalesce(first.isin(*QUESTION_WORDS), F.lit(False))
