"""Spots and counts on pixel grids, and grid reshaping.

Pixels are sparse: ``(gene_idx, px, py, value)`` with zeros absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotgrid.functions.arrays import fill_gaps
from spotgrid.functions.scalars import grid_side
from spotgrid.plans.sizing import bounded

# Upper bound on the serialised bytes of one (px, py, spot_id) row.
WINNER_ROW_BYTES = 64


def scale_coordinates(spots: DataFrame, target_size: int) -> DataFrame:
    """Add ``px, py`` in ``0 .. target_size - 1``, truncated toward zero.

    The range is global: one row of four aggregates, joined back by broadcast.
    A zero range raises, whatever the session's ANSI setting is.
    """
    lo_hi = spots.agg(
        F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y")
    )

    def scaled(axis: str) -> Column:
        lo, hi = F.col(f"lo_{axis}"), F.col(f"hi_{axis}")
        message = F.lit(f"all {axis} coordinates are equal")
        span = F.when(hi > lo, hi - lo).otherwise(F.raise_error(message).cast("double"))
        return ((F.col(axis) - lo) / span * F.lit(target_size - 1)).cast("int")

    joined = spots.crossJoin(F.broadcast(lo_hi))
    return joined.select(*spots.columns, scaled("x").alias("px"), scaled("y").alias("py"))


def pixel_winners(spots: DataFrame, image_size: int) -> DataFrame:
    """The spot shown on each pixel: the largest ``spot_id``, ``(spot_id, px, py)``.

    The winner does not depend on the gene, so it is found on spots alone.  The
    result has at most ``image_size ** 2`` rows.
    """
    scaled = scale_coordinates(spots, image_size)
    return scaled.groupBy("px", "py").agg(F.max("spot_id").alias("spot_id")).select("spot_id", "px", "py")


def rasterize(spots: DataFrame, counts: DataFrame, image_size: int) -> DataFrame:
    """Expression pixels of every gene; a later spot overwrites an earlier one.

    Counts meet the winners by broadcast when the grid is small enough, so the
    long table is filtered where it is read and never shuffled.  A zero of the
    winner hides earlier values (winner first, zeros dropped last); a missing
    count of the winner shows as NaN.
    """
    winners = bounded(pixel_winners(spots, image_size), image_size**2, WINNER_ROW_BYTES)
    shown = counts.join(winners, "spot_id")
    value = F.coalesce(F.col("value").cast("float"), F.lit("NaN").cast("float"))
    return shown.select("gene_idx", "px", "py", value.alias("value")).where(F.col("value") != 0)


def rasterize_points(points: DataFrame, image_size: int, key: str = "gene") -> DataFrame:
    """Raster when each input row ``(key, ord, x, y, value)`` writes one pixel of one gene."""
    scaled = scale_coordinates(points, image_size)
    last = scaled.groupBy(key, "px", "py").agg(F.max_by("value", "ord").alias("value"))
    value = F.coalesce(F.col("value").cast("float"), F.lit("NaN").cast("float"))
    return last.select(key, "px", "py", value.alias("value")).where(F.col("value") != 0)


def dense_images(pixels: DataFrame, height: int, width: int | None = None, genes: DataFrame | None = None) -> DataFrame:
    """One row-major ``ARRAY<FLOAT>`` per gene, zeros filled in.

    Two bounded steps: at most ``width`` entries per image row, then at most
    ``height`` rows per image.  With ``genes(gene_idx)`` every gene of that table
    has an image, blank if it has no pixel; else genes with pixels have.
    """
    width = width or height
    zero = F.lit(0.0).cast("float")
    entry = F.struct(F.col("py").alias("pos"), F.col("value").cast("float").alias("item"))
    rows = pixels.groupBy("gene_idx", "px").agg(fill_gaps(F.collect_list(entry), width, zero).alias("row"))
    blank = F.array_repeat(zero, width)
    entry = F.struct(F.col("px").alias("pos"), F.col("row").alias("item"))
    images = rows.groupBy("gene_idx").agg(fill_gaps(F.collect_list(entry), height, blank).alias("rows"))
    images = images.select("gene_idx", F.flatten("rows").alias("image"))
    if genes is None:
        return images
    every = genes.select("gene_idx").join(images, "gene_idx", "left")
    return every.select("gene_idx", F.coalesce("image", F.array_repeat(zero, height * width)).alias("image"))


def sparse_pixels(images: DataFrame, width: int) -> DataFrame:
    """Inverse of :func:`dense_images`: explode and drop zeros."""
    cells = images.select("gene_idx", F.posexplode("image").alias("pos", "value"))
    row = F.floor(F.col("pos") / F.lit(width)).cast("int")
    col = (F.col("pos") % F.lit(width)).cast("int")
    kept = cells.where(F.col("value") != 0)
    return kept.select("gene_idx", row.alias("px"), col.alias("py"), F.col("value").cast("float").alias("value"))


def resize_nearest(pixels: DataFrame, in_size: int, out_size: int) -> DataFrame:
    """Nearest-neighbour resize of square images, up or down.

    Output pixel ``i`` shows input pixel ``floor(i * in / out)``.  Each input
    pixel emits its own (possibly empty) output range, so no grid is joined.
    """

    def targets(axis: str) -> Column:
        at = F.col(axis).cast("long")
        first = F.ceil(at * F.lit(out_size) / F.lit(in_size)).cast("int")
        last = F.ceil((at + 1) * F.lit(out_size) / F.lit(in_size)).cast("int") - 1
        # sequence() counts down when the end lies before the start, so an empty range needs a guard.
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    spread = pixels.select("gene_idx", F.explode(targets("px")).alias("out_px"), "py", "value")
    spread = spread.select("gene_idx", "out_px", F.explode(targets("py")).alias("out_py"), "value")
    return spread.select("gene_idx", F.col("out_px").alias("px"), F.col("out_py").alias("py"), "value")


def patch_vectors(pixels: DataFrame, image_size: int, layers: int) -> DataFrame:
    """Cut images into a grid of ``d x d`` pixel blocks, ``d = 2 ** layers``.

    Returns ``(gene_idx, prow, pcol, vec)`` for every block that holds a pixel;
    ``vec`` is row-major.  A group has at most ``d * d`` entries.
    """
    grid_side(image_size, layers)
    d = 1 << layers
    block = lambda axis: F.shiftright(F.col(axis).cast("int"), layers)
    inside = F.col("px") % F.lit(d) * F.lit(d) + F.col("py") % F.lit(d)
    entry = F.struct(inside.cast("int").alias("pos"), F.col("value").cast("float").alias("item"))
    grouped = pixels.groupBy("gene_idx", block("px").alias("prow"), block("py").alias("pcol"))
    return grouped.agg(fill_gaps(F.collect_list(entry), d * d, F.lit(0.0).cast("float")).alias("vec"))


def patch_statistic(pixels: DataFrame, image_size: int, layers: int, kind: str = "mean") -> DataFrame:
    """One number per pixel block instead of all its pixels: ``vec`` has length one.

    ``mean`` counts absent pixels as zero; ``sum`` and ``max`` (of a block with
    zeros, at least zero) follow.  Partial aggregates only.
    """
    grid_side(image_size, layers)
    cells = 1 << (2 * layers)
    value = F.col("value").cast("double")
    block = lambda axis: F.shiftright(F.col(axis).cast("int"), layers)
    full = F.count(F.lit(1)) == F.lit(cells)
    results = {
        "mean": F.sum(value) / F.lit(cells),
        "sum": F.sum(value),
        "max": F.when(full, F.max(value)).otherwise(F.greatest(F.max(value), F.lit(0.0))),
    }
    if kind not in results:
        raise ValueError(f"unknown kind {kind!r}")
    grouped = pixels.groupBy("gene_idx", block("px").alias("prow"), block("py").alias("pcol"))
    return grouped.agg(F.array(results[kind]).alias("vec"))


def unpatch(patches: DataFrame, layers: int) -> DataFrame:
    """Inverse of :func:`patch_vectors`; zeros are dropped."""
    d = 1 << layers
    cells = patches.select("gene_idx", "prow", "pcol", F.posexplode("vec").alias("pos", "value"))
    row = F.floor(F.col("pos") / F.lit(d)).cast("int")
    col = (F.col("pos") % F.lit(d)).cast("int")
    return cells.where(F.col("value") != 0).select(
        "gene_idx",
        (F.col("prow") * d + row).alias("px"),
        (F.col("pcol") * d + col).alias("py"),
        "value",
    )


def repeat_channels(pixels: DataFrame, n: int = 3) -> DataFrame:
    """Copy the single channel to ``n`` channels."""
    return pixels.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def renumbered_counts(counts: DataFrame, insitu_genes: DataFrame, scrna_genes: DataFrame) -> DataFrame:
    """Counts under the in-situ index of the gene with the same name; names of one side only go."""
    renumber = scrna_genes.select(F.col("gene_idx").alias("from_idx"), "gene").join(insitu_genes.select("gene_idx", "gene"), "gene")
    return counts.withColumnRenamed("gene_idx", "from_idx").join(renumber, "from_idx").select("gene_idx", "cell_idx", "count")


def paired_samples(counts: DataFrame, pixels: DataFrame, insitu_genes: DataFrame, scrna_genes: DataFrame | None = None) -> DataFrame:
    """For each in-situ gene its count entries and its pixels, in sparse form.

    Returns ``(gene_idx, part, i, j, value)``: ``part = 'count'`` has the cell in
    ``i``; ``part = 'image'`` has the pixel in ``(i, j)``.  Pairing is by index,
    or by gene name when the gene table of the count matrix is given.
    """
    if scrna_genes is None:
        kept = counts.join(insitu_genes.select("gene_idx"), "gene_idx", "left_semi")
    else:
        kept = renumbered_counts(counts, insitu_genes, scrna_genes)
    vector = kept.where(F.col("count") != 0).select(
        "gene_idx",
        F.lit("count").alias("part"),
        F.col("cell_idx").alias("i"),
        F.lit(0).alias("j"),
        F.col("count").cast("double").alias("value"),
    )
    image = pixels.select(
        "gene_idx",
        F.lit("image").alias("part"),
        F.col("px").alias("i"),
        F.col("py").alias("j"),
        F.col("value").cast("double").alias("value"),
    )
    return vector.unionByName(image)


def paired_arrays(vectors: DataFrame, images: DataFrame) -> DataFrame:
    """``samples(gene_idx, counts, image)`` from dense vectors and dense images.

    Sides made with the same ``genes`` table hold every gene, so none is lost here.
    """
    return vectors.join(images, "gene_idx").select("gene_idx", "counts", "image")


