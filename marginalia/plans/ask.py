"""Batches of questions: retrieve, build context, answer, verify; and overview documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..limits import MAX_QUESTION_CHARS, OVERVIEW_TOKENS, SUGGESTION_TOKENS, TOP_K, EngineError
from ..lineage import cut
from ..operators import citations, overview
from ..operators.context import build_context, messages_for
from ..operators.retrieve import retrieve, retrieve_multi
from ..sources.backends import ChatBackend

NO_HIT = "No relevant content found in sources. Try rephrasing the question or adding more sources."
DEGRADED = "LLM endpoint unreachable; skipping answer generation. Showing relevant excerpts:\n"
REWRITE_PROMPT = "Write {n} other search queries for the question below, from other angles and in other words, one per line and nothing else.\nQuestion: {question}"
EXCERPT_CHARS, EXCERPTS, REWRITES = 120, 3, 2


def question_error(question: Column) -> Column:
    """Why a question can't be asked, or null."""
    trimmed = X.strip(F.coalesce(question, F.lit("")))
    return F.when(trimmed == "", "VALIDATION_REQUIRED_FIELD_MISSING").when(F.length(question) > MAX_QUESTION_CHARS, "VALIDATION_FIELD_FORMAT_INVALID")


def rewritten(question: str, reply: str, n: int = REWRITES) -> list[str]:
    """Search queries from generated lines: list marks off, no repeats and not the question itself."""
    seen, out = {question.casefold()}, []
    for line in unicodedata.normalize("NFKC", reply).splitlines():
        query = re.sub(overview.LIST_MARK, "", line.strip()).strip()[:MAX_QUESTION_CHARS]
        if query and query.casefold() not in seen:
            seen.add(query.casefold())
            out.append(query)
    return out[:n]


def rewrite_queries(questions: DataFrame, make: Callable[[], ChatBackend], n: int = REWRITES) -> DataFrame:
    """(query_id, phrasing, notebook_id, query): each question and up to ``n`` rewrites; none where the model fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in frames:
            rows = []
            for key, notebook, question in zip(frame["query_id"], frame["notebook_id"], frame["query"]):
                try:
                    more = rewritten(question, backend.chat([{"role": "user", "content": REWRITE_PROMPT.format(n=n, question=question)}]), n)
                except EngineError:
                    more = []
                rows += [(key, i, notebook, q) for i, q in enumerate([question, *more])]
            yield pd.DataFrame(rows, columns=["query_id", "phrasing", "notebook_id", "query"])

    kinds = {c: questions.schema[c].dataType.simpleString() for c in ("query_id", "notebook_id")}
    return questions.select("query_id", "notebook_id", "query").mapInPandas(run, f"query_id {kinds['query_id']}, phrasing int, notebook_id {kinds['notebook_id']}, query string")


def degraded_text(hits: DataFrame) -> DataFrame:
    """(query_id, text): excerpts of the first three sources, for when no model answers."""
    first = hits.groupBy("query_id", "source_id").agg(F.min_by(F.struct("rank", "text"), "rank").alias("h"))
    every = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("h.rank", "h.text"))), 1, EXCERPTS).alias("r"))
    line = F.transform("r", lambda r, i: F.concat(F.lit("[S"), i + 1, F.lit("] "), F.substring(r["text"], 1, EXCERPT_CHARS)))
    return every.select("query_id", F.concat(F.lit(DEGRADED), F.array_join(line, "\n")).alias("text"))


def generate(prompts: DataFrame, make: Callable[[], ChatBackend]) -> DataFrame:
    """(key, text, failed) for prompts (key, messages); a model that fails leaves text null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in frames:
            out = []
            for key, messages in zip(frame["key"], frame["messages"]):
                try:
                    out.append((key, backend.chat([{"role": m["role"], "content": m["content"]} for m in messages]), False))
                except EngineError:
                    out.append((key, None, True))
            yield pd.DataFrame(out, columns=["key", "text", "failed"])

    return prompts.select("key", "messages").mapInPandas(run, f"key {prompts.schema['key'].dataType.simpleString()}, text string, failed boolean")


def ask(
    chunks: DataFrame, sources: DataFrame, questions: DataFrame, make: Callable[[], ChatBackend], k: int = TOP_K, earlier: DataFrame | None = None,
    phrasings: DataFrame | None = None,
) -> DataFrame:
    """(query_id, text, report): answers to questions (query_id, notebook_id, query, vector) with their checks.

    ``earlier`` has (query_id, messages) of the conversation; ``phrasings`` switches to fused rewrites. A
    model that fails gives excerpts, marked degraded; no hit gives a plain notice.
    """
    hits = cut(retrieve(chunks, questions, k) if phrasings is None else retrieve_multi(chunks, phrasings, k))
    context = cut(build_context(hits, sources))
    past = F.lit(None).cast("array<struct<role:string,content:string>>")
    asked = questions.join(context, "query_id")
    if earlier is not None:
        asked, past = asked.join(earlier.withColumnRenamed("messages", "_past"), "query_id", "left"), F.col("_past")
    prompts = asked.select(F.col("query_id").alias("key"), messages_for(F.col("block"), F.col("query"), past).alias("messages"))
    made = cut(generate(prompts, make).withColumnRenamed("key", "query_id"))  # a model is asked once
    full = made.join(degraded_text(hits).withColumnRenamed("text", "excerpts"), "query_id", "left")
    answers = full.select(F.col("query_id").alias("answer_id"), F.coalesce("text", "excerpts").alias("text"), "failed")
    listed = context.select(F.col("query_id").alias("answer_id"), F.inline("sources"))
    checked = citations.report(answers.select("answer_id", "text"), listed).join(answers, "answer_id")
    report = F.when(F.col("failed"), F.col("report").withField("degraded", F.lit(True)).withField("uncited", F.lit(None).cast("array<string>"))).otherwise(F.col("report"))
    found = checked.select(F.col("answer_id").alias("query_id"), "text", report.alias("report"))
    return questions.select("query_id").join(found, "query_id", "left").withColumn("text", F.coalesce("text", F.lit(NO_HIT)))


def overview_context(chunks: DataFrame, sources: DataFrame, per_source: int, budget: int) -> DataFrame:
    """One context per notebook from evenly spaced chunks of its sources, in source order."""
    picked = overview.sample_chunks(chunks, per_source)
    hits = picked.select(F.col("notebook_id").alias("query_id"), "source_id", "chunk_id", "text", "context", F.struct("source_id", "seq").alias("rank"))
    return build_context(hits, sources, budget)


def studio(chunks: DataFrame, sources: DataFrame, kind: str, make: Callable[[], ChatBackend]) -> DataFrame:
    """(notebook_id, kind, text, report): one document of a kind per notebook."""
    if kind not in overview.KINDS:
        raise EngineError("STUDIO_KIND_INVALID", kind)
    from ..operators.context import SYSTEM_PROMPT

    context = cut(overview_context(chunks, sources, overview.OVERVIEW_CHUNKS_PER_SOURCE, OVERVIEW_TOKENS))
    made = cut(generate(_prompts(context, overview.document_prompt(F.col("block"), kind), SYSTEM_PROMPT), make))
    answers = made.filter("NOT failed").select(F.col("key").alias("answer_id"), "text")
    listed = context.select(F.col("query_id").alias("answer_id"), F.inline("sources"))
    checked = citations.report(answers, listed).join(answers, "answer_id")
    return checked.select(F.col("answer_id").alias("notebook_id"), F.lit(kind).alias("kind"), "text", "report")


def suggest(chunks: DataFrame, sources: DataFrame, make: Callable[[], ChatBackend], n: int = 4) -> DataFrame:
    """(notebook_id, questions): what a reader might ask; none where the model fails."""
    from ..operators.context import SYSTEM_PROMPT

    context = overview_context(chunks, sources, 2, SUGGESTION_TOKENS)
    prompt = F.concat(F.lit("## Sources\n"), "block", F.lit(f"\n\nList {n} questions a reader might ask about these sources, one per line and nothing else."))
    made = generate(_prompts(context, prompt, SYSTEM_PROMPT), make)
    return overview.suggested_questions(made.filter("NOT failed").select(F.col("key").alias("notebook_id"), "text"), n)


def _prompts(context: DataFrame, user: Column, system: str) -> DataFrame:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return context.select(F.col("query_id").alias("key"), F.array(one("system", F.lit(system)), one("user", user)).alias("messages"))
