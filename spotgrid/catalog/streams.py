"""Queries that read a test table as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotgrid.catalog.registry import SQL, query, r6
from spotgrid.operators.raster import scale_coordinates
from spotgrid.plans.session import shared_folder
from spotgrid.sources import tables
from spotgrid.streaming import partials


def _as_files(df, spark):
    """The rows in several files, as they would arrive, and a stream over them."""
    path = shared_folder(spark, "arrivals")
    df.repartition("ord").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("stream_accumulate_metrics", SQL["accumulate_metrics"])
def _(spark, folder):
    stream = _as_files(tables.event_metrics(spark, folder, 8), spark)
    out, log = shared_folder(spark, "partials"), shared_folder(spark, "offsets")
    partials.write_partials(stream, partials.reduce_metrics(8), out, log).awaitTermination()
    return partials.merged_metrics(spark, out).select("step", "key", r6("value").alias("value"))


@query("stream_rasterize_points", SQL["rasterize_points"])
def _(spark, folder):
    scaled = scale_coordinates(tables.points(spark, folder), 64).select("gene", "ord", "px", "py", "value")
    out, log = shared_folder(spark, "partials"), shared_folder(spark, "offsets")
    partials.write_partials(_as_files(scaled, spark), partials.reduce_points(), out, log).awaitTermination()
    pixels = partials.merged_points(spark, out)
    return pixels.select("gene", "px", "py", F.col("value").cast("double").alias("value"))
