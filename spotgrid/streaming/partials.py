"""Large count files and metrics that arrive bit by bit.

Last-write rasters and metric sums merge: reducing every micro-batch on its own
and merging the reductions gives the result of one batch run.  So no streaming
state grows with the data; a micro-batch is reduced, written as one directory
named by its batch id, and a replayed batch replaces its own directory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spotgrid.operators.tracking import accumulate_metrics


def write_partials(
    stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Start a query that writes ``reduce(micro_batch)`` to ``path/batch=N`` for all data now available."""

    def save(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def reduce_metrics(grad_accum: int) -> Callable[[DataFrame], DataFrame]:
    """Partial sums per step and key."""
    return lambda batch: accumulate_metrics(batch, grad_accum)


def merged_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per step and key the sum over all partials."""
    return spark.read.parquet(path).groupBy("step", "key").agg(F.sum("value").alias("value"))


def reduce_points(key: str = "gene") -> Callable[[DataFrame], DataFrame]:
    """Last point per gene and pixel of a micro-batch whose points carry ``px, py``."""
    last = F.max_by("value", "ord").alias("value")
    return lambda batch: batch.groupBy(key, "px", "py").agg(F.max("ord").alias("ord"), last)


def merged_points(spark: SparkSession, path: str, key: str = "gene") -> DataFrame:
    """Pixels of the last point over all partials; zeros dropped, missing values NaN."""
    last = spark.read.parquet(path).groupBy(key, "px", "py").agg(F.max_by("value", "ord").alias("value"))
    value = F.coalesce(F.col("value").cast("float"), F.lit("NaN").cast("float"))
    return last.select(key, "px", "py", value.alias("value")).where(F.col("value") != 0)
