"""A corpus pipeline of five of the llm operators, from raw documents to packed sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import decontaminate, line_dedup, ngram_join, packing, store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7. Empty texts stay."""
    scored = toxicity.score(docs, _table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line nearly equals, n_chars counted anew. A document that had text and keeps none goes."""
    kept = line_dedup.dedup_lines(docs, min_chars=1, with_text=True)
    solid = F.col("kept").rlike("[^\\x20\\x09-\\x0D]")
    kept = kept.where((F.col("n_removed") == 0) | solid)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by near-equal shingle sets the one of the least doc_id; documents without words all stay."""
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"), with_links=False)
    first = groups.where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))
    kept = first.select(F.col("doc_id").alias("k")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("k")), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with a few edits."""
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k")).distinct()
    # a few ids; written, so that the texts aren't searched for the join's sake again
    found = store.written(found)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("k")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, packed into sequences of 2048 ids among lexical neighbours, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("retrieval_packing", pack_sequences),
]

#: No SQL engine expresses the model, the signatures or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that ``pack_sequences`` returns for the table of documents; every stage's output is written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir))
    return docs
