"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import jaccard, language, mixing, packing, queries, substrings
from marginalia.llm.shared import Scratch, fits, free_heaps, fresh, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose nearest profile is this far off is in no known language.
LEAST_SCORE = 0.2
#: Near copies share 80 % or more of their five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Passages of so many words or more stay only where they come first.
PASSAGE_WORDS = 50


def on_free_heaps(stage: Stage) -> Stage:
    """``stage``, before which executors give back what the stages before it made their heaps grow to."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@on_free_heaps
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or near no language's profile.

    Null and empty texts have no letters and go; a null language is never learned from; repeated rows are
    judged each; where nothing can be learned, all go; an empty table stays empty.
    """
    profiles = language.fit(docs.filter(~language.held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    known = language.identify(docs, profiles, names=(pred, score)).filter((F.col(pred) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return known.select(*docs.columns)


@on_free_heaps
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id stays.

    Null and empty texts link with nothing and stay; rows repeated with id and text stand once; an empty
    table stays empty.
    """
    join = jaccard.JaccardJoin(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    found = join.scratch.save(join.run(), "components")
    copies = join.scratch.save(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    left = docs.join(F.broadcast(copies) if fits(copies) else copies, "doc_id", "left_anti").select(*docs.columns)
    again = join.scratch.save(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    few = F.broadcast(again) if fits(again) else again
    once = left.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(few, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


@on_free_heaps
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long passages are cut out of the texts; a document that loses all its words goes.

    Null and empty texts stay, as empty ones; a text that loses nothing keeps its white space; rows that
    share an id are read as one document; an empty table stays empty.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    own = tuple(fresh(docs.columns, c) for c in ("n_words", "n_removed", "kept"))
    found = substrings.SubstringDedup(docs, PASSAGE_WORDS, carry=others, spacing=True, names=own).run()
    n_words, n_removed, kept = map(F.col, own)
    left = found.filter((n_words > n_removed) | (n_words == 0)).withColumn("text", kept)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@on_free_heaps
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source up to its target: whole epochs of it, then documents in random order up to the cut.

    Documents without words are never taken; a null source is one of its own; equal keys go by id; an
    empty table stays empty.
    """
    mixed = mixing.mix(docs, mixing.plan_mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@on_free_heaps
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; a null or empty text is one end token, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack(docs, queries.tokenizer_path(), queries.END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Language profiles and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = queries.table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_scope():  # a stage's own tables go once its result is saved
            docs = scratch.save(stage(spark, docs, sf_dir), str(i))
    return STAGES[-1][1](spark, docs, sf_dir)
