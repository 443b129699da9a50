"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, hilbert, jaccard, language, licenses, mixing, multiindex, oracles, packing, quality, substrings

SHARDS = 40
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = hilbert.plan_shards(docs, ["source", "lang", "n_chars", "doc_id"], SHARDS)
    return plan.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.JaccardJoin(table(spark, sf_dir, "documents"), k=3, percent=90).run()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.SubstringDedup(table(spark, sf_dir, "documents"), length=20).run()
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "epochs", "part")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    profiles = language.fit(docs.filter(~out), "doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.MultiIndex(table(spark, sf_dir, "embeddings"), cosine=0.95).run()


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "v3")
    base = F.col("failed").bitwiseAND(F.lit(quality.policy_mask("v1"))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("rule_bits")
    )


QUERIES = {
    f.__name__: f
    for f in (op1_hilbert_shards, op2_ngram_jaccard, op3_license_scan, op4_suffix_automata, op5_cost_packing, op6_stupid_backoff, op7_source_mix, op8_language_id, op9_multi_index, op10_rule_ledger)
}
#: Elsewhere SQL lacks the hash, the tokenizer or the method, or is too slow; tests hold those to brute force.
ORACLES = {
    "op4_suffix_automata": oracles.SUBSTRING_DEDUP,
    "op7_source_mix": oracles.SOURCE_MIX,
    "op10_rule_ledger": oracles.RULE_LEDGER,
}
