"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, best-fit packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import common, jaccard_join, line_dedup, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.5 or more; learns from the labels that docs has texts for, outside the held-out fold."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines of 50 words or more; keeps every document, n_chars follows the text."""
    return line_dedup.dedup_lines(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, 75 %) the document with the least doc_id."""
    return jaccard_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_dedup_stage), ("n-gram jaccard join", jaccard_stage), ("best-fit packing", packing_stage)]

#: The classifier and the tokenizer can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
