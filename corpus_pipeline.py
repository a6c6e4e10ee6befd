"""Corpus pipeline over documents: each stage is one operator, written as Parquet and read back as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last one returns
doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left. Null texts are empty texts throughout: they aren't
toxic, are copies of one another, and hold no benchmark words. An empty table passes through. Repeated rows and ties: of a group of copies one row stays, that with the
smallest doc_id. Texts are read whole, however long. Further columns of documents stay with their rows to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlas.llm import bpe, common, decontam, jaccard, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers don't call toxic. They learn from these documents and the labels beside them."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id."""
    return jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.remove(docs, common.table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs)


STAGES = [("toxicity", clean), ("near duplicates", distinct), ("decontamination", decontaminated), ("tokens", tokenised)]

#: SQL has no classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    work = common.Work(spark)
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.settle(spark)
    return docs
