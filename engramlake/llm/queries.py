"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import chat_format, decontaminate, line_dedup, ngram_join, order_minhash, packing, recompression, sql, suffix_dedup, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"), evidence=True).drop("text")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.format_turns(turns.unionByName(probe)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_token_counts, op2_suffix_dedup, op3_line_dedup, op4_toxicity, op5_document_fingerprints, op6_chat_formatting, op7_benchmark_decontamination, op8_substring_dedup, op9_ngram_jaccard_join, op10_retrieval_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": sql.OP2, "op3_line_dedup": sql.OP3, "op6_chat_formatting": sql.OP6, "op8_substring_dedup": sql.OP8, "op9_ngram_jaccard_join": sql.OP9}
