"""A cleaning pipeline over ``documents``: five stages, each applying one operator.

``run`` writes every stage's result as Parquet in the folder that the cluster shares and
hands what it rereads to the next stage. All stages but the last return the columns of
``documents``; the last returns the packing. Stages work on whatever rows, columns and
texts their predecessor kept, and on empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import cut, release, small_batches, temporary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-labelling classifier rejects go.

    The result is written here, in small Arrow batches: whole rows pass through Python.
    """
    from marginalia.llm import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark):
        model = quality.fit(docs, labels)
    return cut(quality.keep_good(docs, model), "good")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    from marginalia.llm import exact_dedup

    index = exact_dedup.new_index(spark)
    stay = exact_dedup.deduplicate(docs, index)
    index.drop()
    return stay


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    from marginalia.llm import jaccard_join

    return jaccard_join.keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    from marginalia.llm import secret_scans

    return secret_scans.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts placed in token sequences."""
    from marginalia.llm import packing

    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary() as keep:
            before, docs = docs, keep(cut(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(before)
    return docs
