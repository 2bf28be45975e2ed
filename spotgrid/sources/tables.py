"""Adapters from relational tables to the canonical tables.

Customers act as spots, part brands as genes, suppliers as cells and bought
quantities as counts; embeddings act as small square images; events act as
point measurements and as training metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: an embedding of 64 numbers is an 8 x 8 image.
EMBEDDING_SIDE = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of the test data."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spots(spark: SparkSession, folder: str) -> DataFrame:
    """``spots(spot_id, x, y)``."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("long").alias("spot_id"),
        F.col("c_acctbal").cast("double").alias("x"),
        F.col("c_nationkey").cast("double").alias("y"),
    )


def genes(spark: SparkSession, folder: str) -> DataFrame:
    """``genes(gene_idx, gene)``: the brand dictionary in name order.

    A dictionary row set (one entry per brand), not a data table: the sorted set
    of names fits one row.
    """
    names = table(spark, folder, "part").agg(F.sort_array(F.collect_set("p_brand")).alias("names"))
    return names.select(F.posexplode("names").alias("gene_idx", "gene"))


def _gene_of_part(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    return parts.join(genes(spark, folder), "gene").select("l_partkey", "gene_idx")


def insitu_long(spark: SparkSession, folder: str) -> DataFrame:
    """``insitu_long(spot_id, gene_idx, value)``: quantity of a brand bought by a customer."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    owners = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = items.join(_gene_of_part(spark, folder), "l_partkey").join(owners, "l_orderkey")
    summed = joined.groupBy(F.col("o_custkey").cast("long").alias("spot_id"), "gene_idx").agg(
        F.sum("l_quantity").cast("float").alias("value")
    )
    return summed.select("spot_id", "gene_idx", "value")


def scrna_long(spark: SparkSession, folder: str) -> DataFrame:
    """``scrna_long(gene_idx, cell_idx, count)``: quantity of a brand sold by a supplier."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    joined = items.join(_gene_of_part(spark, folder), "l_partkey")
    return joined.groupBy("gene_idx", F.col("l_suppkey").cast("int").alias("cell_idx")).agg(
        F.sum("l_quantity").cast("float").alias("count")
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """``points(gene, ord, x, y, value)``: one measurement per event."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("gene"),
        F.col("event_id").alias("ord"),
        F.col("user_id").cast("double").alias("x"),
        F.col("value").cast("double").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("value"),
    )


def embedding_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a sparse 8 x 8 image keyed by ``gene_idx = vec_id``."""
    cells = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("gene_idx"), F.posexplode("embedding").alias("pos", "value")
    )
    row = F.floor(F.col("pos") / F.lit(EMBEDDING_SIDE)).cast("int")
    col = (F.col("pos") % F.lit(EMBEDDING_SIDE)).cast("int")
    return cells.where(F.col("value") != 0).select("gene_idx", row.alias("px"), col.alias("py"), "value")


def embedding_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """``conditions(sample_id, cond)``: the label of every embedding."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("sample_id"), F.col("label").cast("long").alias("cond")
    )


def turns(spark: SparkSession, folder: str) -> int:
    """Turns of the longest conversation."""
    return 1 + table(spark, folder, "conversations").agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0]


def event_metrics(spark: SparkSession, folder: str, per_step: int) -> DataFrame:
    """``metrics(step, key, value, ord)``: consecutive events form the steps."""
    step = F.floor(F.col("event_id") / F.lit(per_step)).cast("long")
    return table(spark, folder, "events").select(
        step.alias("step"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("ord")
    )


def logit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``pairs(fake, real)``: two critic logits per line item."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_discount") * 40.0 - 2.0).alias("fake"), (F.col("l_tax") * 50.0 - 2.0).alias("real")
    )


def labelled_logits(spark: SparkSession, folder: str) -> DataFrame:
    """``logits(doc_id, logit, label)``: a length score against the quality label."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    logit = (F.col("n_chars") / 1000.0 - 2.0).alias("logit")
    return marks.join(docs, "doc_id").select("doc_id", logit, "label")
