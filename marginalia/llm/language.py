"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 letters, words padded with a blank) in
order of frequency. A document is compared with each profile by the out-of-place distance: for each of
its own most frequent n-grams, how far its rank is from the profile's, or the full depth if the profile
lacks it. The nearest language wins; ties go to the first by name.

Profiles are fitted on about ``per_language`` documents of a language, those whose id hashes below that
share of the language; the bound is a parameter. Predictions read whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null language or text is
never learned from; with nothing to learn from, all is ``und``; equal distances go to the first language
by name; repeated rows are predicted each on its own; an empty table gives an empty result; other columns
are carried as they are, but for one that has an output's name, which is replaced (``names`` renames them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytewise
from .shared import fresh, light_batches

DEPTH = 400
PER_LANGUAGE = 1000
UNKNOWN = "und"
_C1, _C2, _C3 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Each code point's small letter, and 32 (a blank) for what is no letter."""
    global _table
    if _table is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(len(table)):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0]) if low else c
        _table = table
    return _table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a text and their counts, most frequent first; ties by hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate(([np.uint32(32)], _letters()[points], [np.uint32(32), np.uint32(32)]))
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # one blank between words
    c = c[keep].astype(np.uint32)
    if len(c) < 2:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    one = c * _C1
    one ^= one >> np.uint32(15)
    inner = c[1:-1] != 32
    two = one[:-1] * _C2 + c[1:] * _C3
    two ^= two >> np.uint32(13)
    three = (two[:-1] * _C1) ^ (one[2:] * _C2)
    three ^= three >> np.uint32(16)
    codes = np.concatenate((one[c != 32], two, three[inner]))
    codes.sort()
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    values, counts = codes[edge], np.diff(np.append(edge, len(codes)))
    return values, counts


def top(values: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent values, most frequent first; ties by value."""
    if len(values) > depth:
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        some = counts >= least
        values, counts = values[some], counts[some]
    return values[np.lexsort((values, -counts))][:depth]


class Profiles:
    """Ranked n-grams of each language, as one sorted table for lookups."""

    def __init__(self, ranked: dict[str, list[int]], depth: int):
        self.depth, self.languages = depth, sorted(ranked)
        rows = sorted((g, k, r) for k, name in enumerate(self.languages) for r, g in enumerate(ranked[name]))
        self.keys = np.unique(np.array([g for g, _, _ in rows], np.uint32))
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int32)
        for g, k, r in rows:
            self.ranks[np.searchsorted(self.keys, np.uint32(g)), k] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        own = top(*grams(text), self.depth)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == own[found]
        ranks = self.ranks[np.where(found, at, len(self.keys))]
        place = np.arange(len(own), dtype=np.int32)[:, None]
        distance = np.where(ranks < 0, self.depth, np.abs(ranks - place)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (self.depth * len(own))


def fit(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, depth: int = DEPTH, per_language: int = PER_LANGUAGE
) -> Profiles:
    """Profiles of the non-null languages in ``docs``; the driver receives ``depth`` rows a language."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    shares = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    shares = F.broadcast(known.sparkSession.createDataFrame(shares.collect(), shares.schema))  # one row a language
    place = F.xxhash64("id").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    learned = known.join(shares, "lang").filter(place < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, counts = grams(text)
                found.setdefault(lang, Counter()).update(dict(zip(values.tolist(), counts.tolist())))
        for lang, counter in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counter)), pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())],
                ["lang", "gram", "n"],
            )

    totals = learned.mapInArrow(bytewise.tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = totals.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= depth)
    by_language: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "gram", "rank").collect():
        by_language.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return Profiles({lang: [g for _, g in sorted(pairs)] for lang, pairs in by_language.items()}, depth)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score (1 less the distance as a share of the largest possible)."""
    light_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # depth x languages entries
    replaced = {n.lower() for n in names}
    others = [c for c in docs.columns if c.lower() not in replaced]
    place = next((i for i, c in enumerate(others) if c.lower() == text_col.lower()), None)
    asked = [] if place is not None else [F.col(text_col).alias(fresh(others, "_text"))]  # texts go to a worker once

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(place or 0)]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[len(asked) :], *made], [*others, *names])

    schema = docs.select(*others).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*asked, *others).mapInArrow(bytewise.tidied(predict), schema)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1
