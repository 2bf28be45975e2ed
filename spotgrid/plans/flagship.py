"""The minimum end-to-end flow: expression maps next to count statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.operators.raster import rasterize
from spotgrid.sources import tables


def expression_maps(spark: SparkSession, folder: str, image_size: int = 16) -> DataFrame:
    """For every gene its non-zero pixels with its total count and number of expressing cells."""
    pixels = rasterize(tables.spots(spark, folder), tables.insitu_long(spark, folder), image_size)
    stats = tables.scrna_long(spark, folder).groupBy("gene_idx").agg(
        F.sum(F.col("count").cast("double")).alias("total"), F.count_if(F.col("count") != 0).alias("expressing")
    )
    named = pixels.join(tables.genes(spark, folder), "gene_idx").join(stats, "gene_idx")
    return named.select("gene", "px", "py", F.col("value").cast("double").alias("value"), "total", "expressing")
