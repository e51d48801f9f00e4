"""Every stage of the pipeline on its own input, against brute force where no model is involved."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from engramlake.llm import store

from .test_llm import check_pieces, jaccard_components, shingles


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = store.written(stage(spark, docs, sf))
        out[name] = docs, made
        docs = made
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for docs, made in list(stages.values())[:-1]:
        assert made.columns == docs.columns


def test_toxicity_keeps_clean_documents(stages, spark, sf):
    docs, made = stages["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").select("doc_id")
    assert clean.join(made, "doc_id", "left_anti").count() <= 0.02 * clean.count()


def test_line_dedup_changes_only_what_repeats(stages):
    docs, made = stages["line_dedup"]
    both = docs.select("doc_id", F.col("text").alias("old")).join(made, "doc_id")
    for r in both.collect():
        assert (r.n_chars == len(r.text) if r.text != r.old else True) and set(r.text.split("\n")) <= set(r.old.split("\n"))
    assert both.where("text = old").count() > 0


def test_one_of_each_group_stays(stages):
    docs, made = stages["ngram_jaccard_join"]
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    roots = jaccard_components([shingles(t) for _, t in rows], 80)
    assert sorted(r.doc_id for r in made.collect()) == [rows[k][0] for k, root in enumerate(roots) if k == root]


def test_contaminated_documents_go(stages, spark, sf):
    docs, made = stages["benchmark_decontamination"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in made.collect()}
    for r in docs.collect():
        if any(x in " ".join(r.text.lower().split()) for x in items):
            assert r.doc_id not in kept
    assert len(kept) > 0.8 * docs.count()


def test_packing_holds_every_id(stages):
    docs, made = stages["retrieval_packing"]
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    order = {d: k for k, (d, _) in enumerate(rows)}

    class Piece:
        def __init__(self, r):
            self.__dict__.update(r.asDict(), doc_id=order[r.doc_id])

    check_pieces([Piece(r) for r in made.collect()], [t for _, t in rows], 2048)
