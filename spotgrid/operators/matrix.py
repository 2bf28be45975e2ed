"""Count-matrix features: dense vectors, cell embeddings, projections and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotgrid.functions.arrays import add_vectors, fill_gaps
from spotgrid.functions.keyed import uniform
from spotgrid.operators.vector_sums import sparse_times_dense
from spotgrid.plans.sizing import bounded

# Fixed value: default width of a cell embedding.
EMBED_DIM = 18

# A dense vector is one row; wider matrices use blocks.
MAX_VECTOR = 1 << 22


def num_cells(cells: DataFrame) -> DataFrame:
    """One-row table ``num_cells``: rows of the cell table, cells without any count included."""
    return cells.agg(F.count(F.lit(1)).alias("num_cells"))


def num_genes(genes: DataFrame) -> DataFrame:
    """One-row table ``num_genes``: rows of the gene table, genes without any count included."""
    return genes.agg(F.count(F.lit(1)).alias("num_genes"))


def gene_vector_blocks(counts: DataFrame, cells: int, block: int, genes: DataFrame | None = None) -> DataFrame:
    """Count vectors cut into blocks of cells: ``(gene_idx, block, counts)``.

    A group has at most ``block`` entries, however many cells there are.  A block
    without entries is all zero; it is absent unless ``genes(gene_idx)`` asks for
    all blocks of all its genes.  A ``cell_idx`` of ``cells`` or more raises.
    """
    pos = (F.col("cell_idx") % F.lit(block)).cast("int")
    entry = F.struct(pos.alias("pos"), F.col("count").cast("float").alias("item"))
    at = F.floor(F.col("cell_idx") / F.lit(block)).cast("int")
    at = F.when(F.col("cell_idx") >= cells, F.raise_error(F.lit(f"a cell_idx lies beyond {cells} cells")).cast("int")).otherwise(at)
    grouped = counts.groupBy("gene_idx", at.alias("block")).agg(F.collect_list(entry).alias("entries"))
    if genes is not None:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-cells // block) - 1))))
        grouped = genes.select("gene_idx", numbers.alias("block")).join(grouped, ["gene_idx", "block"], "left")
        grouped = grouped.withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<pos:int,item:float>>")))
    size = F.least(F.lit(block), F.lit(cells) - F.col("block") * F.lit(block))
    return grouped.select("gene_idx", "block", fill_gaps(F.col("entries"), size, F.lit(0.0).cast("float")).alias("counts"))


def gene_vectors(counts: DataFrame, cells: int, genes: DataFrame | None = None) -> DataFrame:
    """Whole count vector per gene in cell order: ``(gene_idx, counts)``; with ``genes``, of every gene."""
    if cells > MAX_VECTOR:
        raise ValueError(f"{cells} cells do not fit one row; use gene_vector_blocks")
    return gene_vector_blocks(counts, cells, cells, genes).select("gene_idx", "counts")


def dense_counts(counts: DataFrame, cells: int, genes: DataFrame, block: int = 4096) -> DataFrame:
    """``(gene_idx, cell_idx, count)`` of every cell of every gene, zeros included."""
    size = min(block, cells)
    blocks = gene_vector_blocks(counts, cells, size, genes)
    exploded = blocks.select("gene_idx", "block", F.posexplode("counts").alias("pos", "count"))
    return exploded.select("gene_idx", (F.col("block") * size + F.col("pos")).cast("int").alias("cell_idx"), "count")


def cell_embedding(cells: DataFrame, dim: int = EMBED_DIM, seed: int = 0) -> DataFrame:
    """One keyed random vector per cell: ``(cell_idx, vec)``, uniform in +-sqrt(6 / (cells + dim))."""
    total = cells.agg(F.count(F.lit(1)).alias("n"))
    bound = F.sqrt(F.lit(6.0) / (F.col("n") + F.lit(dim)))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: (F.lit(2.0) * uniform(seed, "cell_idx", d) - F.lit(1.0)) * F.col("bound"),
    )
    return cells.crossJoin(F.broadcast(total.select(bound.alias("bound")))).select("cell_idx", draws.alias("vec"))


def embed_counts(counts: DataFrame, cell_emb: DataFrame) -> DataFrame:
    """``context(gene_idx, cell_idx, vec)``: cell embedding followed by the count."""
    joined = counts.join(cell_emb, "cell_idx")
    vec = F.concat(F.col("vec"), F.array(F.col("count").cast("double")))
    return joined.select("gene_idx", "cell_idx", vec.alias("vec"))


def project_counts(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Count channel: ``(gene_idx, vec)``, sparse counts times ``weights(cell_idx, w)``."""
    dense = weights.select("cell_idx", F.col("w").alias("vec"))
    product = sparse_times_dense(counts, "gene_idx", "cell_idx", "count", dense)
    return product.select("gene_idx", F.col("total").alias("vec"))


def project_embedding(cell_emb: DataFrame, weights: DataFrame) -> DataFrame:
    """Embedding channels: ``(channel, vec)``, computed once because all genes share them."""
    entries = cell_emb.select("cell_idx", F.posexplode("vec").alias("channel", "v"))
    dense = weights.select("cell_idx", F.col("w").alias("vec"))
    product = sparse_times_dense(entries, "channel", "cell_idx", "v", dense)
    return product.select("channel", F.col("total").alias("vec"))


def context_mask(context: DataFrame) -> DataFrame:
    """``(gene_idx, channel, usable)``: true if any cell of the channel is not zero."""
    values = context.select("gene_idx", F.posexplode("vec").alias("channel", "v"))
    return values.groupBy("gene_idx", "channel").agg(F.bool_or(F.col("v") != 0).alias("usable"))


def dense_context_mask(counts: DataFrame, cell_emb: DataFrame, genes: DataFrame, dim: int) -> DataFrame:
    """:func:`context_mask` over every cell of every gene, without making the dense context.

    All genes share the embedding channels; the count channel, numbered ``dim``, is
    usable if the gene has a count that is not zero.
    """
    shared = context_mask(cell_emb.select(F.lit(0).alias("gene_idx"), "vec")).select("channel", "usable")
    some = counts.where(F.col("count") != 0).select("gene_idx").distinct().withColumn("_some", F.lit(True))
    own = genes.select("gene_idx").join(some, "gene_idx", "left")
    own = own.select("gene_idx", F.lit(dim).alias("channel"), F.coalesce("_some", F.lit(False)).alias("usable"))
    return genes.select("gene_idx").crossJoin(bounded(shared, dim, 16)).unionByName(own)


def embed_tokens(
    tokens: DataFrame, token_emb: DataFrame, pos_emb: DataFrame, vocab: int, seq_len: int, dim: int
) -> DataFrame:
    """``(sample_id, pos, vec)``: token vector plus position vector.

    The embedding tables have ``vocab`` and ``seq_len`` rows of ``dim`` doubles,
    which decides the broadcast.
    """
    row = 8 * dim + 64
    by_token = bounded(token_emb.select("token_id", F.col("vec").alias("token_vec")), vocab, row)
    by_pos = bounded(pos_emb.select("pos", F.col("vec").alias("pos_vec")), seq_len, row)
    joined = tokens.join(by_token, "token_id").join(by_pos, "pos")
    return joined.select("sample_id", "pos", add_vectors(F.col("token_vec"), F.col("pos_vec")).alias("vec"))


def append_context(context: DataFrame, cond_tokens: DataFrame, token_emb: DataFrame, vocab: int, dim: int) -> DataFrame:
    """Add embedded low-resolution tokens to ``context(sample_id, slot, vec, usable)``.

    Appended rows come from ``cond_tokens(sample_id, pos, token_id)``, have
    ``source = 'token'`` and are always usable.
    """
    by_token = bounded(token_emb.select("token_id", "vec"), vocab, 8 * dim + 64)
    extra = cond_tokens.join(by_token, "token_id").select(
        "sample_id", F.col("pos").alias("slot"), "vec", F.lit(True).alias("usable"), F.lit("token").alias("source")
    )
    base = context.select("sample_id", "slot", "vec", "usable", F.lit("count").alias("source"))
    return base.unionByName(extra)
