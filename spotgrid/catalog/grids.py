"""Queries for rasters, grid reshaping and sample pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotgrid.catalog import inputs
from spotgrid.catalog.registry import R6, part, query, r6
from spotgrid.operators import raster
from spotgrid.operators.mosaics import mosaic
from spotgrid.plans.dataset import SampleSet
from spotgrid.plans.flagship import expression_maps
from spotgrid.sources import tables


def _pixels(spark, folder, size=16):
    return raster.rasterize(tables.spots(spark, folder), tables.insitu_long(spark, folder), size)


@query(
    "expression_maps",
    """SELECT gene, px, py, CAST(value AS DOUBLE) AS value, total, expressing FROM t_pixels JOIN t_genes USING (gene_idx)
    JOIN (SELECT gene_idx, CAST(sum(cnt) AS DOUBLE) AS total, count(*) FILTER (WHERE cnt <> 0) AS expressing FROM t_scrna GROUP BY 1) USING (gene_idx)""",
)
def _(spark, folder):
    return expression_maps(spark, folder)


@query("rasterize", "SELECT gene_idx, px, py, CAST(value AS DOUBLE) AS value FROM t_pixels")
def _(spark, folder):
    return _pixels(spark, folder).select("gene_idx", "px", "py", F.col("value").cast("double").alias("value"))


@query(
    "rasterize_points",
    """SELECT gene, px, py, CAST(k AS DOUBLE) AS value FROM (
    SELECT event_type AS gene, CAST(trunc((user_id - lx) / (hx - lx) * 63) AS INTEGER) AS px,
           CAST(trunc((value - ly) / (hy - ly) * 63) AS INTEGER) AS py,
           arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE), event_id) AS k
    FROM events, (SELECT CAST(min(user_id) AS DOUBLE) AS lx, CAST(max(user_id) AS DOUBLE) AS hx, min(value) AS ly, max(value) AS hy FROM events)
    GROUP BY 1, 2, 3) WHERE k <> 0""",
)
def _(spark, folder):
    pixels = raster.rasterize_points(tables.points(spark, folder), 64)
    return pixels.select("gene", "px", "py", F.col("value").cast("double").alias("value"))


@query(
    "dense_images",
    """SELECT g.gene_idx, CAST(i AS INTEGER) AS pos, CAST(coalesce(p.value, 0) AS DOUBLE) AS value
    FROM (SELECT DISTINCT gene_idx FROM t_pixels) g CROSS JOIN (SELECT unnest(range(256)) AS i)
    LEFT JOIN t_pixels p ON p.gene_idx = g.gene_idx AND p.px * 16 + p.py = i""",
)
def _(spark, folder):
    images = raster.dense_images(_pixels(spark, folder), 16)
    cells = images.select("gene_idx", F.posexplode("image").alias("pos", "value"))
    return cells.select("gene_idx", "pos", F.col("value").cast("double").alias("value"))


@query(
    "paired_samples",
    """SELECT gene_idx, 'count' AS part, cell_idx AS i, 0 AS j, CAST(cnt AS DOUBLE) AS value FROM t_scrna WHERE cnt <> 0
    UNION ALL SELECT gene_idx, 'image', px, py, CAST(value AS DOUBLE) FROM t_pixels""",
)
def _(spark, folder):
    return raster.paired_samples(
        tables.scrna_long(spark, folder), _pixels(spark, folder), tables.genes(spark, folder)
    )


part("b_genes", "SELECT CAST(doc_id AS INTEGER) AS gene_idx, 'gene' || (doc_id + 7) % 1000 AS gene FROM documents")
part("b_counts", "SELECT CAST(conv_id AS INTEGER) AS gene_idx, CAST(turn AS INTEGER) AS cell_idx, CAST(length(text) AS DOUBLE) AS cnt FROM conversations")


def _documents_as_genes(spark, folder):
    """One gene per document; few have an image or counts."""
    docs = tables.table(spark, folder, "documents")
    name = F.concat(F.lit("gene"), ((F.col("doc_id") + 7) % 1000).cast("string"))
    return docs.select(F.col("doc_id").cast("int").alias("gene_idx"), name.alias("gene"))


def _turns_as_counts(spark, folder):
    turns = tables.table(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").cast("int").alias("gene_idx"), F.col("turn").cast("int").alias("cell_idx"), F.length("text").cast("float").alias("count")
    )


def _sample_set(spark, folder, scrna_genes=None):
    pixels = tables.embedding_pixels(spark, folder)
    return SampleSet(pixels, _turns_as_counts(spark, folder), _documents_as_genes(spark, folder), inputs.SIZE, scrna_genes)


@query(
    "paired_arrays",
    """SELECT g.gene_idx, 'count' AS part, CAST(i AS INTEGER) AS pos, coalesce(cnt, 0) AS value FROM b_genes g CROSS JOIN (SELECT unnest(range((SELECT max(turn) + 1 FROM conversations))) AS i)
    LEFT JOIN b_counts c ON c.gene_idx = g.gene_idx AND c.cell_idx = i
    UNION ALL SELECT g.gene_idx, 'image', CAST(i AS INTEGER), coalesce(CAST(e.value AS DOUBLE), 0) FROM b_genes g CROSS JOIN (SELECT unnest(range(64)) AS i)
    LEFT JOIN e_pixels e ON e.gene_idx = g.gene_idx AND e.px * 8 + e.py = i""",
)
def _(spark, folder):
    pairs = _sample_set(spark, folder).arrays(tables.turns(spark, folder))
    cells = lambda part, array: pairs.select("gene_idx", F.lit(part).alias("part"), F.posexplode(array).alias("pos", "value"))
    both = cells("count", "counts").unionByName(cells("image", "image"))
    return both.select("gene_idx", "part", "pos", F.col("value").cast("double").alias("value"))


@query(
    "paired_by_name",
    """SELECT g.gene_idx, 'count' AS part, cell_idx AS i, 0 AS j, cnt AS value FROM b_counts c
    JOIN (SELECT CAST(page_id AS INTEGER) AS from_idx, 'gene' || page_id AS gene FROM pages) p ON p.from_idx = c.gene_idx JOIN b_genes g ON g.gene = p.gene WHERE cnt <> 0
    UNION ALL SELECT gene_idx, 'image', px, py, CAST(value AS DOUBLE) FROM e_pixels""",
)
def _(spark, folder):
    pages = tables.table(spark, folder, "pages")
    names = pages.select(F.col("page_id").cast("int").alias("gene_idx"), F.concat(F.lit("gene"), F.col("page_id").cast("string")).alias("gene"))
    return _sample_set(spark, folder, names).by_name().pairs()


part(
    "e_small",
    "SELECT gene_idx, CAST(o AS INTEGER) AS px, CAST(q AS INTEGER) AS py, value FROM (SELECT unnest(range(5)) AS o), (SELECT unnest(range(5)) AS q), e_pixels"
    " WHERE px = o * 8 // 5 AND py = q * 8 // 5",
)


@query("resize_nearest_down", f"SELECT gene_idx, px, py, {R6('value')} AS value FROM e_small")
def _(spark, folder):
    out = raster.resize_nearest(tables.embedding_pixels(spark, folder), 8, 5)
    return out.select("gene_idx", "px", "py", r6("value").alias("value"))


@query(
    "resize_nearest_up",
    f"""SELECT gene_idx, CAST(o AS INTEGER) AS px, CAST(q AS INTEGER) AS py, {R6('value')} AS value
    FROM e_pixels, (SELECT unnest(range(11)) AS o), (SELECT unnest(range(11)) AS q) WHERE px = o * 8 // 11 AND py = q * 8 // 11""",
)
def _(spark, folder):
    out = raster.resize_nearest(tables.embedding_pixels(spark, folder), 8, 11)
    return out.select("gene_idx", "px", "py", r6("value").alias("value"))


@query(
    "patch_vectors",
    """SELECT gene_idx, CAST(px // 4 AS INTEGER) AS prow, CAST(py // 4 AS INTEGER) AS pcol, CAST(i AS INTEGER) AS pos,
    CAST(sum(CASE WHEN (px % 4) * 4 + py % 4 = i THEN value ELSE 0 END) AS DOUBLE) AS value
    FROM t_pixels, (SELECT unnest(range(16)) AS i) GROUP BY 1, 2, 3, 4""",
)
def _(spark, folder):
    cells = raster.patch_vectors(_pixels(spark, folder), 16, 2)
    cells = cells.select("gene_idx", "prow", "pcol", F.posexplode("vec").alias("pos", "value"))
    return cells.select("gene_idx", "prow", "pcol", "pos", F.col("value").cast("double").alias("value"))


@query(
    "patch_statistic",
    f"""SELECT gene_idx, CAST(px // 4 AS INTEGER) AS prow, CAST(py // 4 AS INTEGER) AS pcol, {R6('sum(value) / 16')} AS mean,
    {R6('CASE WHEN count(*) = 16 THEN max(value) ELSE greatest(max(value), 0) END')} AS peak FROM t_pixels GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    pixels = _pixels(spark, folder)
    mean = raster.patch_statistic(pixels, 16, 2).withColumn("mean", r6(F.col("vec")[0])).drop("vec")
    peak = raster.patch_statistic(pixels, 16, 2, "max").withColumn("peak", r6(F.col("vec")[0])).drop("vec")
    return mean.join(peak, ["gene_idx", "prow", "pcol"])


@query("unpatch", "SELECT gene_idx, px, py, CAST(value AS DOUBLE) AS value FROM t_pixels")
def _(spark, folder):
    back = raster.unpatch(raster.patch_vectors(_pixels(spark, folder), 16, 2), 2)
    return back.select("gene_idx", "px", "py", F.col("value").cast("double").alias("value"))


def _tile(table: str, r: int) -> str:
    k = f"(CAST(gene_idx AS BIGINT) * 2 + {r})"
    value = "least(greatest(CAST(value AS DOUBLE), 0.0), 1.0)"
    return f"SELECT ({k} // 2) * 10 + 2 + px AS my, ({k} % 2) * 10 + 2 + py AS mx, {value} AS value FROM {table}"


@query(
    "mosaic",
    f"SELECT my, mx, {R6('value')} AS value FROM ({_tile('e_pixels', 0)} UNION ALL {_tile('e_recon', 1)}) WHERE value > 0",
)
def _(spark, folder):
    picture = mosaic(tables.embedding_pixels(spark, folder), inputs.recon(spark, folder), 8)
    return picture.select("my", "mx", r6("value").alias("value"))
