"""Mechanical checks of citations in generated text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# fixed values: how a citation looks (after NFKC), and the thresholds of support
BRACKETS = r"\[([^\[\]]+)\]"
NUMBER = r"[Ss]\s*(\d+)"
CONFIRMED_FROM = 0.30
MISATTRIBUTED_GAP = 0.20
LOW_COVERAGE = 0.5
LEAST_CLAIM_CHARS = 5
# fixed values: how an answer says that the sources don't
DISCLAIMERS = (
    "記載なし", "記載がない", "記載は見当たら", "見つかりませんでした", "not in the source", "not mentioned", "not found in the source",
)


def cited(normal: Column) -> Column:
    """Distinct source numbers in brackets, ascending, of a text already in NFKC."""
    spans = X.matches(normal, BRACKETS, 1)
    numbers = F.flatten(F.transform(spans, lambda s: X.matches(s, NUMBER, 1)))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.coalesce(n.try_cast("long"), F.lit((1 << 63) - 1)))))


def valid(numbers: Column, n: Column) -> Column:
    return F.filter(numbers, lambda c: (c >= 1) & (c <= n))


def invalid(numbers: Column, n: Column) -> Column:
    return F.filter(numbers, lambda c: (c < 1) | (c > n))


def coverage(numbers: Column, n: Column) -> Column:
    """Share of the sources that are cited."""
    return F.when(n > 0, F.size(F.array_distinct(numbers)) / n).otherwise(F.lit(0.0))


def bare(normal: Column) -> Column:
    """A sentence without its bracketed parts."""
    return X.strip(F.regexp_replace(normal, BRACKETS, " "))


def claim_grams(text: Column) -> Column:
    return X.bigram_set(X.squeezed(text))


def overlap(claim: Column, source: Column) -> Column:
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, source)) / F.size(claim)).otherwise(F.lit(0.0))


def sentence_rows(answers: DataFrame) -> DataFrame:
    """(answer_id, at, raw, normal, numbers, bare): the non-empty sentences of answers (answer_id, text)."""
    rows = answers.select("answer_id", F.posexplode(F.transform(X.sentences(F.col("text")), X.strip)).alias("at", "raw")).filter("raw <> ''")
    rows = rows.withColumn("normal", X.nfkc("raw"))
    return rows.select("*", cited(F.col("normal")).alias("numbers"), bare(F.col("normal")).alias("bare"))


def uncited(answers: DataFrame) -> DataFrame:
    """(answer_id, uncited): claims without a citation, in order.

    A sentence is no claim if it is short, a question or says that the sources are silent; a fragment of
    citations only vouches for the sentence before it.
    """
    rows = sentence_rows(answers)
    claims = F.length(F.regexp_replace("bare", r"(?U)\s+", "")) >= LEAST_CLAIM_CHARS
    silent = F.lit(False)
    for marker in DISCLAIMERS:
        silent = silent | F.col("raw").contains(marker)
    rows = rows.withColumns({"claims": claims, "cites": F.size("numbers") > 0, "excused": silent | X.looks_like_question(F.col("normal"))})
    following = Window.partitionBy("answer_id").orderBy("at")
    vouched = F.coalesce(F.lead(F.col("cites") & ~F.col("claims")).over(following), F.lit(False))
    flagged = rows.withColumn("vouched", vouched).filter("claims AND NOT cites AND NOT excused AND NOT vouched")
    found = flagged.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("r")).select("answer_id", F.col("r.raw").alias("uncited"))
    return answers.select("answer_id").join(found, "answer_id", "left").select("answer_id", F.coalesce("uncited", F.array().cast("array<string>")).alias("uncited"))


_BRACKET, _SNUM = re.compile(BRACKETS), re.compile(NUMBER)


def _grams(text: str) -> frozenset[str]:
    squeezed = "".join(text.lower().split())
    return frozenset(a + b for a, b in zip(squeezed, squeezed[1:]))


def claims_of(text: str, n_sources: set[int]) -> Iterator[tuple[int, frozenset[str]]]:
    """(number, bigrams of what it is cited for) through an answer.

    A citation alone refers to the last claim; in a sentence that cites in several places, each citation
    stands for the words since the one before.
    """
    last: frozenset[str] = frozenset()
    for raw in re.split(X.SENTENCE_END, text):
        sentence = unicodedata.normalize("NFKC", raw.strip())
        spans = [(m, {int(x) for x in _SNUM.findall(m[1])} & n_sources) for m in _BRACKET.finditer(sentence)]
        spans = [(m, numbers) for m, numbers in spans if numbers]
        own = _grams(_BRACKET.sub(" ", sentence))
        claim = own or last
        last = own or last
        if not spans or not claim:
            continue
        by_number = {n: claim for _, numbers in spans for n in numbers}
        if len(spans) > 1:
            start = 0
            for m, numbers in spans:
                clause = _grams(_BRACKET.sub(" ", sentence[start : m.start()]))
                start = m.end()
                if clause:  # a marker right behind another says nothing of its own
                    by_number |= {n: clause for n in numbers}
        yield from by_number.items()


def grounding(answers: DataFrame, bodies: DataFrame) -> DataFrame:
    """(answer_id, confirmed, misattributed) for answers (answer_id, text) and bodies (answer_id, s, body).

    Claims are cut in Python, one row per claim; their support is counted against every source of the
    answer by joins, so an answer's sources are never gathered in one task.
    """
    numbers = bodies.groupBy("answer_id").agg(F.collect_set("s").alias("ns"))
    kind = answers.schema["answer_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, at, n, sorted(grams))
                for key, text, ns in zip(batch["answer_id"], batch["text"], batch["ns"])
                for at, (n, grams) in enumerate(claims_of(text or "", {int(x) for x in ns}))
            ]
            yield pd.DataFrame(rows, columns=["answer_id", "at", "n", "claim"])

    claims = answers.join(numbers, "answer_id").select("answer_id", "text", "ns").mapInPandas(cut, f"answer_id {kind}, at int, n int, claim array<string>")
    normal = bodies.select("answer_id", "s", X.nfkc("body").alias("body"))
    sources = normal.select("answer_id", "s", claim_grams(F.col("body")).alias("grams"))
    scored = claims.join(sources, "answer_id").select("answer_id", "at", "n", "s", overlap(F.col("claim"), F.col("grams")).alias("o"))
    per_claim = scored.groupBy("answer_id", "at", "n").agg(
        F.max(F.when(F.col("s") == F.col("n"), F.col("o"))).alias("own"), F.coalesce(F.max(F.when(F.col("s") != F.col("n"), F.col("o"))), F.lit(0.0)).alias("best")
    )
    sure = F.col("own") >= CONFIRMED_FROM
    wrong = ~sure & (F.col("best") >= CONFIRMED_FROM) & (F.col("best") - F.col("own") >= MISATTRIBUTED_GAP)
    sets = [F.array_sort(F.collect_set(F.when(test, F.col("n")))).alias(name) for test, name in ((sure, "confirmed"), (wrong, "misattributed"))]
    found = per_claim.groupBy("answer_id").agg(*sets)
    none = F.array().cast("array<int>")
    out = answers.select("answer_id").join(found, "answer_id", "left")
    return out.select("answer_id", F.coalesce("confirmed", none).alias("confirmed"), F.coalesce("misattributed", none).alias("misattributed"))


def report(answers: DataFrame, sources: DataFrame, check_uncited: bool = True) -> DataFrame:
    """(answer_id, report): all checks of answers (answer_id, text) with sources (answer_id, s, source_id, title, section, body, chunk_ids)."""
    number = F.concat(F.lit("S"), F.col("s"))

    def by_number(value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(number.alias("k"), value.alias("v"))))))

    some = F.when(F.coalesce("section", F.lit("")) != "", F.col("section"))
    ids = F.when(F.size("chunk_ids") > 0, F.col("chunk_ids"))
    maps = sources.groupBy("answer_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_sources"), by_number(F.col("title")).alias("source_map"), by_number(F.col("source_id").cast("long")).alias("source_id_map"),
        by_number(F.col("body")).alias("source_excerpts"), by_number(some).alias("source_contexts"), by_number(ids).alias("source_chunk_ids"),
    )
    checked = answers.withColumn("numbers", cited(X.nfkc("text"))).join(maps, "answer_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    checked = checked.join(grounding(answers, sources.select("answer_id", "s", "body")), "answer_id").join(uncited(answers), "answer_id")
    n = F.col("n_sources")
    good = valid(F.col("numbers"), n)
    open_claims = F.when(F.lit(check_uncited) & (n > 0) & (F.size("uncited") > 0), F.col("uncited"))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    row = F.struct(
        good.alias("cited"), invalid(F.col("numbers"), n).alias("invalid"), coverage(good, n).alias("coverage"), n.alias("n_sources"), "source_map", "source_id_map",
        "confirmed", "misattributed", F.lit(None).cast("boolean").alias("degraded"), "source_excerpts", full("source_contexts").alias("source_contexts"),
        full("source_chunk_ids").alias("source_chunk_ids"), open_claims.alias("uncited"),
    )
    return checked.select("answer_id", row.alias("report"))
