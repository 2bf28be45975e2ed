"""Side-by-side grids of original and reconstructed images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotgrid.functions.scalars import clamp

# Images per row and the border between them.
PER_ROW = 2
BORDER = 2

# Keys per range within which images are numbered.
RANGE = 1 << 16


def consecutive(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct integer keys with their rank from 0 in ``name``; ranked in ranges of keys, not in one task."""
    ranged = keys.withColumn("_range", F.floor(F.col(key) / F.lit(RANGE)).cast("long"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of keys
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_inside", inside).join(offsets, "_range").select(key, (F.col("_before") + F.col("_inside")).alias(name))


def mosaic(
    images: DataFrame, recons: DataFrame, size: int, nrow: int = PER_ROW, padding: int = BORDER, genes: DataFrame | None = None
) -> DataFrame:
    """``(my, mx, value)``: one large picture with the originals next to their copies.

    The images of ``genes(gene_idx)``, or of all genes on either side, are numbered
    from 0 in order; original ``i`` is tile ``2 i`` and its reconstruction tile
    ``2 i + 1``.  Values are clamped to [0, 1], missing ones stay NaN; background is
    zero and absent.
    """
    shown = images.select("gene_idx").union(recons.select("gene_idx")) if genes is None else genes.select("gene_idx")
    numbered = consecutive(shown.distinct(), "gene_idx", "_image")

    def placed(side: DataFrame, r: int) -> DataFrame:
        side = side.join(numbered, "gene_idx")
        k = F.col("_image") * 2 + F.lit(r)
        tile_row, tile_col = F.floor(k / F.lit(nrow)).cast("long"), k % F.lit(nrow)
        pitch = F.lit(size + padding)
        return side.select(
            (tile_row * pitch + F.lit(padding) + F.col("px")).cast("long").alias("my"),
            (tile_col * pitch + F.lit(padding) + F.col("py")).cast("long").alias("mx"),
            clamp(F.col("value").cast("double"), 0.0, 1.0).alias("value"),
        )

    return placed(images, 0).unionByName(placed(recons, 1)).where((F.col("value") > 0) | F.isnan("value"))
