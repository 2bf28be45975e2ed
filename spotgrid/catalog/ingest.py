"""Queries for file readers, checks, snapshots and result folders.

The text files are written by Spark from the test tables into the shared folder
and read back by the readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.catalog import inputs
from spotgrid.catalog.registry import query
from spotgrid.functions.arrays import fill_gaps
from spotgrid.operators.raster import rasterize
from spotgrid.plans.session import shared_folder
from spotgrid.sinks import snapshots
from spotgrid.sources import files, tables
from spotgrid.sources.checks import validate_dataset


def _write_lines(lines: DataFrame, order: str, header: str, path: str) -> None:
    """Write ``line`` in global order, each part file starting with the header."""
    ordered = lines.repartitionByRange(order).sortWithinPartitions(order)
    options = {"header": "true", "sep": "\u0001", "quote": "", "escape": "", "emptyValue": ""}
    ordered.select(F.col("line").alias(header)).write.options(**options).csv(path)


def _number(value):
    return F.format_string("%.1f", value.cast("double"))


def write_insitu(spark: SparkSession, folder: str, path: str) -> None:
    """Spots-by-genes TSV of the bought quantities."""
    names = [r["gene"] for r in tables.genes(spark, folder).orderBy("gene_idx").collect()]
    entry = F.struct(F.col("gene_idx").alias("pos"), _number(F.col("value")).alias("item"))
    packed = tables.insitu_long(spark, folder).groupBy("spot_id").agg(F.collect_list(entry).alias("entries"))
    every = tables.spots(spark, folder).select("spot_id").join(packed, "spot_id", "left")
    entries = F.coalesce("entries", F.array().cast("array<struct<pos:int,item:string>>"))
    line = F.array_join(fill_gaps(entries, len(names), F.lit("0")), "\t")
    _write_lines(every.select("spot_id", line.alias("line")), "spot_id", "\t".join(names), path)


def write_locations(spark: SparkSession, folder: str, path: str) -> None:
    """Spot coordinates as TSV."""
    line = F.concat_ws("\t", F.col("x").cast("string"), F.col("y").cast("string"))
    _write_lines(tables.spots(spark, folder).select("spot_id", line.alias("line")), "spot_id", "x\ty", path)


def write_scrna(spark: SparkSession, folder: str, path: str) -> None:
    """Genes-by-cells CSV with quoted gene names."""
    cells = [f"cell{r['c']}" for r in tables.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c")).orderBy("c").collect()]
    entry = F.struct(F.col("cell_idx").alias("pos"), _number(F.col("count")).alias("item"))
    packed = tables.scrna_long(spark, folder).groupBy("gene_idx").agg(F.collect_list(entry).alias("entries"))
    values = F.array_join(fill_gaps(F.col("entries"), len(cells), F.lit("0")), ",")
    line = F.concat(F.lit('"'), F.col("gene"), F.lit('",'), values)
    lines = packed.join(tables.genes(spark, folder), "gene_idx").select("gene_idx", line.alias("line"))
    _write_lines(lines, "gene_idx", "," + ",".join(cells), path)


@query("read_wide_counts", "SELECT spot_id, gene_idx, gene, CAST(value AS DOUBLE) AS value FROM t_insitu JOIN t_genes USING (gene_idx) WHERE value <> 0")
def _(spark, folder):
    path = shared_folder(spark, "insitu")
    write_insitu(spark, folder, path)
    counts, genes = files.read_wide_counts(spark, path)
    return counts.join(genes, "gene_idx").select("spot_id", "gene_idx", "gene", F.col("value").cast("double").alias("value"))


@query("read_locations", "SELECT spot_id, x, y FROM t_spots")
def _(spark, folder):
    path = shared_folder(spark, "locations")
    write_locations(spark, folder, path)
    return files.read_locations(spark, path)


@query(
    "read_count_matrix",
    """SELECT gene_idx, cell_idx, gene, 'cell' || cell_idx AS cell, CAST(cnt AS DOUBLE) AS value FROM t_scrna JOIN t_genes USING (gene_idx) WHERE cnt <> 0""",
)
def _(spark, folder):
    path = shared_folder(spark, "scrna")
    write_scrna(spark, folder, path)
    counts, genes, cells = files.read_count_matrix(spark, path)
    named = counts.join(genes, "gene_idx").join(cells, "cell_idx")
    return named.select("gene_idx", "cell_idx", "gene", "cell", F.col("count").cast("double").alias("value"))


@query(
    "header_index",
    """SELECT gene_idx, gene, CAST((SELECT count(*) FROM supplier) AS INTEGER) AS cells, CAST((SELECT count(*) FROM t_genes) AS INTEGER) AS genes FROM t_genes""",
)
def _(spark, folder):
    insitu, scrna = shared_folder(spark, "insitu"), shared_folder(spark, "scrna")
    write_insitu(spark, folder, insitu)
    write_scrna(spark, folder, scrna)
    cells = files.header_width(spark, scrna, ",", skip=1).withColumnRenamed("width", "cells")
    genes = files.header_width(spark, insitu, "\t").withColumnRenamed("width", "genes")
    return files.gene_index(spark, insitu).crossJoin(cells).crossJoin(genes)


@query("load_dataset", "SELECT gene_idx, px, py, CAST(value AS DOUBLE) AS value FROM t_pixels")
def _(spark, folder):
    path = shared_folder(spark, "dataset")
    write_insitu(spark, folder, f"{path}/{files.INSITU_FILE}")
    write_locations(spark, folder, f"{path}/{files.LOCATION_FILE}")
    write_scrna(spark, folder, f"{path}/{files.SCRNA_FILE}")
    data = files.load_dataset(spark, path + "/")
    pixels = rasterize(data.spots, data.insitu, 16)
    return pixels.select("gene_idx", "px", "py", F.col("value").cast("double").alias("value"))


@query(
    "validate_dataset",
    """SELECT 'spots' AS "check", 'spots ' || (SELECT count(*) FROM t_spots) || ', count rows ' || count(*) AS detail
        FROM documents HAVING count(*) <> (SELECT count(*) FROM t_spots)
    UNION ALL SELECT 'genes', 'genes ' || count(*) || ', matrix rows ' || (SELECT count(*) FROM t_genes)
        FROM part HAVING count(*) > (SELECT count(*) FROM t_genes)
    UNION ALL SELECT 'divisible', 'image size 7, divisor 2'
    UNION ALL SELECT 'inputs', 'exactly one of counts and embeddings is needed'
    UNION ALL SELECT 'condition', 'super-resolution needs a condition image size'
    UNION ALL SELECT 'sequence', 'tokens 9, limit 8'
    UNION ALL SELECT 'codebook', 'cells ' || count(*) || ', codes 64' FROM supplier HAVING count(*) <> 64
    UNION ALL SELECT 'image', 'pixel ' || max(greatest(px, py)) || ', image size 7' FROM e_pixels HAVING max(greatest(px, py)) >= 7
    UNION ALL SELECT 'tokens', 'position ' || max(pos) || ', limit 8' FROM e_tokens HAVING max(pos) >= 8""",
)
def _(spark, folder):
    return validate_dataset(
        tables.spots(spark, folder),
        tables.table(spark, folder, "documents").select(F.col("doc_id").alias("spot_id")),
        tables.table(spark, folder, "part").select("p_partkey"),
        tables.genes(spark, folder),
        tables.table(spark, folder, "supplier").select("s_suppkey"),
        image_size=7,
        layers=1,
        codebook_size=64,
        seq_len=8,
        pixels=tables.embedding_pixels(spark, folder),
        tokens=inputs.tokens(spark, folder),
        has_embeddings=True,
        superres=True,
    )


@query("snapshots", "SELECT gene_idx, px, py, CAST(value AS DOUBLE) AS value FROM t_pixels")
def _(spark, folder):
    path = shared_folder(spark, "snapshots")
    pixels = rasterize(tables.spots(spark, folder), tables.insitu_long(spark, folder), 16)
    for step in (0, 3, 5):
        rows = pixels if step == 5 else pixels.where(F.col("value") < 0)
        snapshots.write_snapshot(rows, path, step, every=5)
    latest = snapshots.load_snapshot(spark, path)
    return latest.select("gene_idx", "px", "py", F.col("value").cast("double").alias("value"))


@query("prepare_results", "SELECT gene_idx, count(*) AS pixels FROM t_pixels GROUP BY 1")
def _(spark, folder):
    path = shared_folder(spark, "results")
    snapshots.prepare_results(spark, path)
    pixels = rasterize(tables.spots(spark, folder), tables.insitu_long(spark, folder), 16)
    snapshots.write_snapshot(tables.genes(spark, folder), path, 9)
    snapshots.prepare_results(spark, path, clear=True)
    snapshots.write_snapshot(pixels.groupBy("gene_idx").agg(F.count(F.lit(1)).alias("pixels")), path, 0)
    return snapshots.load_snapshot(spark, path)
