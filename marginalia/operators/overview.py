"""Overview documents: evenly spaced chunks, prompts by kind, and suggested questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..limits import OVERVIEW_CHUNKS_PER_SOURCE

#: What each kind of document is asked to be.
KINDS = {
    "briefing": "Write a short briefing in Markdown over all sources: a summary of up to three sentences, key points as bullets, caveats.",
    "study_guide": "Write a study guide in Markdown: the key concepts explained, five questions, and a model answer to each with citations.",
    "faq": "Write five to eight questions with answers in Markdown; every answer cites its source.",
    "timeline": "List the events and dates of the sources in order of time, in Markdown; undated ones last, as date unknown.",
    "mindmap": "Show the concepts of all sources as nested Markdown bullets: one root, at most three levels.",
}
CITE = "Cite every statement of fact as [S number]."
# fixed values: how list items begin in generated text (after NFKC)
LIST_MARK = r"^(?:\(\d+\)\s*|\d+[.)、]\s*|[-*·•–—・]\s*)"


def sample_chunks(chunks: DataFrame, per_source: int = OVERVIEW_CHUNKS_PER_SOURCE) -> DataFrame:
    """The chunks of each source at evenly spaced places, first and last included; score 1."""
    if per_source <= 0:
        return chunks.limit(0).withColumn("score", F.lit(1.0))
    last = chunks.groupBy("source_id").agg(F.max("seq").alias("last"))
    if per_source == 1:
        places = F.array(F.lit(0).cast("long"))
    else:
        spaced = F.transform(F.sequence(F.lit(0), F.lit(per_source - 1)), lambda i: F.floor(i * F.col("last") / (per_source - 1)))
        every = F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))
        places = F.when(F.col("last") + 1 <= per_source, every).otherwise(F.array_distinct(spaced))
    wanted = last.select("source_id", F.explode(places).alias("seq")).withColumn("seq", F.col("seq").cast("int"))
    return chunks.join(wanted, ["source_id", "seq"]).withColumn("score", F.lit(1.0))


def document_prompt(context: Column, kind: str) -> Column:
    return F.concat(F.lit("## Sources\n"), context, F.lit(f"\n\n## Instructions\n{KINDS[kind]}\n{CITE}"))


def suggested_questions(generated: DataFrame, n: int = 4) -> DataFrame:
    """(notebook_id, questions): up to ``n`` lines of generated text (notebook_id, text) that ask something."""
    rows = generated.select("notebook_id", F.posexplode(X.lines(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("q", X.strip(F.regexp_replace(X.nfkc(X.strip(F.col("line"))), LIST_MARK, "")))
    asked = rows.filter((F.length("q") >= 2) & X.looks_like_question(F.col("q")))
    kept = asked.groupBy("notebook_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "q"))), 1, n).alias("r"))
    return kept.select("notebook_id", F.col("r.q").alias("questions"))
