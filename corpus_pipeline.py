"""The corpus pipeline: stages over whole documents, each written and read again.

Documents that the quality rules or the classifier reject go; one document of each
group of near copies stays; sources are mixed to their target weights, where a
document that the mix takes twice appears twice and one that it leaves out goes;
what remains is encoded.  All stages but the last return the columns of their
input.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.llm import mixing, pieces, quality_crf, quality_rules, simhash
from spotgrid.llm.registry import table
from spotgrid.plans.session import shared_folder


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@lru_cache(maxsize=2)
def classifier(spark: SparkSession, sf_dir: str) -> quality_crf.Model:
    """The classifier of a session and a folder, fitted once.

    It learns from labelled rows of the whole table: the rules before it leave hardly
    any bad example to learn from.
    """
    return quality_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or more."""
    return docs.where(quality_crf.score_texts(classifier(spark, sf_dir), F.col("text")) >= quality_crf.THRESHOLD)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, weighed by the classifier's scores."""
    weight = "weight"
    while weight in docs.columns:  # names of the caller's columns stay free
        weight += "_"
    scored = docs.withColumn(weight, quality_crf.score_texts(classifier(spark, sf_dir), F.col("text")))
    return mixing.take(scored, weight=weight).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, and whether they gave its text back."""
    both = pieces.encode(docs.select("doc_id", "text"), decoded="decoded")
    return both.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("SimHash near-dedup", near_copies_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
#: The classifier and the searches are beyond SQL; tests hold every stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage-{position}")
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
