"""Inputs that several registered queries share, all derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.functions.scalars import flatten_pos
from spotgrid.operators.codebook import assign_codes, code_sums
from spotgrid.operators.raster import patch_vectors
from spotgrid.plans.session import cut_lineage
from spotgrid.sources import tables

# Embedding images: 8 x 8 pixels, 2 x 2 blocks, so 4 x 4 positions; one code per (label, position).
SIZE = 8
LAYERS = 1
SIDE = 4
LABELS = 10
CODES = LABELS * SIDE * SIDE


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """Block vectors of the embedding images."""
    return patch_vectors(tables.embedding_pixels(spark, folder), SIZE, LAYERS)


def codebook(spark: SparkSession, folder: str, blocks: DataFrame | None = None) -> DataFrame:
    """Mean block per (label, position)."""
    blocks = patches(spark, folder) if blocks is None else blocks
    labels = tables.embedding_conditions(spark, folder).select(F.col("sample_id").cast("int").alias("gene_idx"), "cond")
    code = F.col("cond") * (SIDE * SIDE) + flatten_pos(F.col("prow"), F.col("pcol"), SIDE)
    members = blocks.join(labels, "gene_idx").select(code.cast("int").alias("code_id"), "vec")
    # At most CODES rows that a query reads several times; each time would go through all blocks again.
    return cut_lineage(code_sums(members).select("code_id", F.transform("total", lambda x: x / F.col("n")).alias("vec")))


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with their code."""
    blocks = cut_lineage(patches(spark, folder))
    return assign_codes(blocks, codebook(spark, folder, blocks))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``tokens(sample_id, pos, token_id)`` of the embedding images."""
    return assigned(spark, folder).select(
        F.col("gene_idx").cast("long").alias("sample_id"),
        flatten_pos(F.col("prow"), F.col("pcol"), SIDE).alias("pos"),
        F.col("code_id").alias("token_id"),
    )


def recon(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding images after encoding and decoding."""
    from spotgrid.operators.codebook import detokenize

    return detokenize(tokens(spark, folder), codebook(spark, folder), SIZE, LAYERS, CODES)
