"""Quality rules as a bitmask ledger: measure and judge once, then apply policies to the bits.

``ledger`` scans the texts once and stores, per document, every measurement and one bit per failed
rule. A policy is a set of rules with a version; ``apply_policy`` and ``ablate`` read only the ledger,
so a new policy never reads a text again.

Defined cases: a null or empty text has no words, all measurements 0, and fails ``few_words`` only;
texts of any length are measured whole; repeated rows are judged each on its own; an empty table
gives an empty ledger; columns of the input other than the id and the text are not carried over, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise

RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "odd_word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "few_letter_words": "100 * n_letter_words < 60 * n_words",
    "shouting": "100 * n_upper_words > 40 * n_words",
    "few_distinct_words": "n_words >= 50 AND 100 * n_distinct_words < 10 * n_words",
}
#: Policies by version. A document is kept if it fails none of its policy's rules.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "few_letter_words", "shouting"),
    "v3": tuple(RULES),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words",
    "n_upper_words", "n_distinct_words",
)


def _set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = _set(b"[#*$%&|<>]"[1:-1])
_UPPER = _set(bytes(range(ord("A"), ord("Z") + 1)))
_SMALL = _set(bytes(range(ord("a"), ord("z") + 1)))
_LETTER = _UPPER | _SMALL | _set(bytes(range(0x80, 0x100)))
_HEAD = ~_set(bytes(range(0x80, 0xC0)))  # bytes that begin a code point


def _per_text(where: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(where, minlength=n).astype(np.int64)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it stands for its value (one of each)."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first[order[1:][same]] = False
    return again, first


def measure(texts: bytewise.Texts) -> dict[str, np.ndarray]:
    n = len(texts)
    counts = np.diff(texts.word_offsets)
    out = {"n_words": counts.astype(np.int64)}
    out["word_chars"] = texts.sums(texts.inside & _HEAD[texts.data])
    out["n_symbols"] = texts.sums(_SYMBOL[texts.data])
    owner = np.repeat(np.arange(n), counts)
    spans = (texts.starts, texts.ends)
    upper, small = texts.sums(_UPPER[texts.data], *spans), texts.sums(_SMALL[texts.data], *spans)
    out["n_letter_words"] = _per_text(owner[texts.sums(_LETTER[texts.data], *spans) > 0], n)
    out["n_upper_words"] = _per_text(owner[(upper > 1) & (small == 0)], n)

    salt = bytewise.mix(np.arange(1, n + 1, dtype=np.uint64))
    words = texts.words()
    _, first = _repeats(words ^ salt[owner])
    out["n_distinct_words"] = _per_text(owner[first], n)
    runs, at = texts.runs(words, 3)
    again, _ = _repeats(runs ^ salt[owner[at]])
    covered = np.zeros(len(words) + 3, bool)
    for j in range(3):
        covered[at[again] + j] = True
    out["n_repeat_words"] = _per_text(owner[covered[: len(words)]], n)

    cut = texts.data == 0x0A
    ends = np.flatnonzero(cut)
    lows = np.sort(np.concatenate((texts.offsets[:-1], ends + 1)), kind="stable")
    # every text ends its last line, every line break its own; both lists have one entry per line
    highs = np.sort(np.concatenate((texts.offsets[1:], ends)), kind="stable")
    line_owner = np.repeat(np.arange(n), texts.sums(cut) + 1)
    worded = np.searchsorted(texts.starts, highs) > np.searchsorted(texts.starts, lows)
    lows, highs, line_owner = lows[worded], highs[worded], line_owner[worded]
    _, first = _repeats(texts.hashes(lows, highs) ^ salt[line_owner])
    out["n_lines"] = _per_text(line_owner, n)
    out["n_dup_lines"] = _per_text(line_owner[~first], n)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in bytewise.slices(batch.column(1)):
            found = measure(texts)
            ids = batch.column(0).slice(row, len(texts))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[k]) for k in MEASURES)], ["_id", *MEASURES])


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, all measurements and ``failed``, one bit per failed rule."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES)
    measured = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_batches, schema)
    failed = " | ".join(f"CASE WHEN {test} THEN {bit(rule)}L ELSE 0L END" for rule, test in RULES.items())
    return measured.withColumn("failed", F.expr(failed)).withColumnRenamed("_id", id_col)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablate(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it fails, those it alone rejects, and those kept without it."""
    mask = policy_mask(policy)
    own = F.col("failed").bitwiseAND(F.lit(mask))
    counts = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.count_if(own.bitwiseAND(F.lit(bit(rule))) != 0).alias("n_failed"),
            F.count_if(own == bit(rule)).alias("n_only_this"),
            F.count_if(own.bitwiseAND(F.lit(mask & ~bit(rule))) == 0).alias("n_kept_without"),
        )
        for rule in POLICIES[policy]
    ]
    return book.agg(F.array(*counts).alias("r")).select(F.inline("r"))
