"""From the files of a data set to paired samples."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.operators import codebook, matrix, raster
from spotgrid.sources.files import DataSet, load_dataset


@dataclass(frozen=True)
class SampleSet:
    """Sparse images and counts of the genes of a data set, keyed by ``gene_idx``."""

    pixels: DataFrame
    counts: DataFrame
    genes: DataFrame
    image_size: int
    scrna_genes: DataFrame | None = None

    def by_name(self) -> SampleSet:
        """The same samples with counts paired to images by gene name instead of by index.

        A name that one side repeats pairs with each of its rows.
        """
        if self.scrna_genes is None:
            raise ValueError("pairing by name needs the gene table of the count matrix")
        return replace(self, counts=raster.renumbered_counts(self.counts, self.genes, self.scrna_genes), scrna_genes=None)

    def pairs(self) -> DataFrame:
        """Sparse pairs of count vector and image."""
        return raster.paired_samples(self.counts, self.pixels, self.genes)

    def _own_counts(self) -> DataFrame:
        return self.counts.join(self.genes.select("gene_idx"), "gene_idx", "left_semi")

    def arrays(self, cells: int) -> DataFrame:
        """Dense pairs ``(gene_idx, counts, image)`` of every gene, blank or not."""
        images = raster.dense_images(self.pixels, self.image_size, genes=self.genes)
        return raster.paired_arrays(matrix.gene_vectors(self._own_counts(), cells, self.genes), images)

    def count_blocks(self, cells: int, block: int) -> DataFrame:
        """Count vectors of every gene in blocks, for matrices too wide for :meth:`arrays`."""
        return matrix.gene_vector_blocks(self._own_counts(), cells, block, self.genes)


def build_samples(data: DataSet, image_size: int) -> SampleSet:
    """Rasterise a data set; nothing is collected."""
    pixels = raster.rasterize(data.spots, data.insitu, image_size)
    return SampleSet(pixels, data.scrna, data.genes, image_size, data.scrna_genes)


def read_samples(spark: SparkSession, folder: str, image_size: int) -> SampleSet:
    """Read and rasterise the three files of a folder."""
    return build_samples(load_dataset(spark, folder), image_size)


def gene_conditions(counts: DataFrame, weights: DataFrame, k: int, seed: int, genes: DataFrame | None = None) -> DataFrame:
    """``conditions(sample_id, cond)``: genes grouped by their projected count vectors.

    With ``genes(gene_idx)`` every gene has a condition; one without counts gets
    that of the blank code, 0.
    """
    projected = matrix.project_counts(counts, weights)
    groups = codebook.fit_codebook(projected, k, seed)
    assigned = codebook.assign_codes(projected, groups)
    found = assigned.select(F.col("gene_idx").cast("long").alias("sample_id"), F.col("code_id").cast("long").alias("cond"))
    if genes is None:
        return found
    every = genes.select(F.col("gene_idx").cast("long").alias("sample_id")).join(found, "sample_id", "left")
    return every.select("sample_id", F.coalesce("cond", F.lit(0).cast("long")).alias("cond"))
