"""Queries for scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotgrid.catalog.registry import GUMBEL, LOGC, R6, U, query, r6
from spotgrid.functions import arrays, keyed, scalars
from spotgrid.operators.raster import repeat_channels, scale_coordinates
from spotgrid.sources import tables


@query("scale_coordinates", "SELECT spot_id, px, py FROM t_scaled")
def _(spark, folder):
    return scale_coordinates(tables.spots(spark, folder), 16).select("spot_id", "px", "py")


@query("clamp", f"SELECT c_custkey, {R6('least(greatest(c_acctbal, 0.0), 5000.0)')} AS clamped FROM customer")
def _(spark, folder):
    rows = tables.table(spark, folder, "customer")
    return rows.select("c_custkey", r6(scalars.clamp(F.col("c_acctbal"), 0, 5000)).alias("clamped"))


@query(
    "fmap_size",
    "SELECT doc_id, CAST(n_chars // 16 AS INTEGER) AS side, CAST(16 AS INTEGER) AS divisor FROM documents",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "documents")
    return rows.select(
        "doc_id", scalars.fmap_size(F.col("n_chars"), 4).alias("side"), scalars.dim_divisor(4).alias("divisor")
    )


@query("cosine_schedule", f"SELECT event_id, {R6('cos(value / 500.0 * pi() * 0.5)')} AS share FROM events")
def _(spark, folder):
    rows = tables.table(spark, folder, "events")
    return rows.select("event_id", r6(scalars.cosine_schedule(F.col("value") / 500.0)).alias("share"))


@query(
    "l2_normalize",
    f"""SELECT vec_id, CAST(pos AS INTEGER) AS pos, {R6('v / greatest(n, 1e-12)')} AS value FROM (
    SELECT gene_idx AS vec_id, pos, CAST(value AS DOUBLE) AS v,
           sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE)) OVER (PARTITION BY gene_idx)) AS n FROM e_cells)""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "embeddings")
    unit = rows.select(F.col("vec_id").cast("int").alias("vec_id"), F.posexplode(arrays.l2_normalize(F.col("embedding"))).alias("pos", "v"))
    return unit.select("vec_id", "pos", r6("v").alias("value"))


@query(
    "layer_norm",
    f"""SELECT vec_id, CAST(pos AS INTEGER) AS pos, {R6('(v - m) / sqrt(s + 1e-5) * (pos + 1) / 64.0')} AS added,
    {R6('(v - m) / sqrt(greatest(s, 1e-5))')} AS floored FROM (
    SELECT gene_idx AS vec_id, pos, CAST(value AS DOUBLE) AS v, avg(CAST(value AS DOUBLE)) OVER (PARTITION BY gene_idx) AS m,
           var_pop(CAST(value AS DOUBLE)) OVER (PARTITION BY gene_idx) AS s FROM e_cells)""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), "embedding")
    gamma = F.transform("embedding", lambda x, i: (i + 1) / 64.0)
    both = F.arrays_zip(
        arrays.layer_norm(F.col("embedding"), gamma, "add").alias("a"),
        arrays.layer_norm(F.col("embedding"), None, "clamp").alias("c"),
    )
    cells = rows.select("vec_id", F.posexplode(both).alias("pos", "z"))
    return cells.select("vec_id", "pos", r6("z.a").alias("added"), r6("z.c").alias("floored"))


@query(
    "safe_log_div",
    f"""SELECT l_orderkey, l_linenumber, {R6('ln(l_discount + 1e-10)')} AS shifted, {R6(LOGC('l_tax'))} AS floored,
    {R6('l_tax / greatest(l_discount, 1e-8)')} AS ratio FROM lineitem""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "lineitem")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        r6(scalars.safe_log(F.col("l_discount"), "add")).alias("shifted"),
        r6(scalars.safe_log(F.col("l_tax"), "clamp")).alias("floored"),
        r6(scalars.safe_div(F.col("l_tax"), F.col("l_discount"))).alias("ratio"),
    )


@query(
    "uniform_gumbel",
    f"SELECT o_orderkey, {R6('u')} AS u, {R6(GUMBEL('u'))} AS gumbel FROM (SELECT o_orderkey, {U(3407, 'o_orderkey')} AS u FROM orders)",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "orders").select("o_orderkey", keyed.uniform(3407, "o_orderkey").alias("u"))
    return rows.select("o_orderkey", r6("u").alias("u"), r6(keyed.gumbel_noise(F.col("u"))).alias("gumbel"))


@query(
    "prob_mask",
    f"SELECT o_orderkey, {U(11, 'o_orderkey')} < 0.3 AS kept, true AS every, false AS none FROM orders",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "orders")
    return rows.select(
        "o_orderkey",
        keyed.prob_mask(0.3, 11, "o_orderkey").alias("kept"),
        keyed.prob_mask(1, 11, "o_orderkey").alias("every"),
        keyed.prob_mask(0, 11, "o_orderkey").alias("none"),
    )


@query(
    "repeat_channels",
    f"SELECT gene_idx, px, py, CAST(c AS INTEGER) AS channel, {R6('value')} AS value FROM e_pixels, (SELECT unnest(range(3)) AS c)",
)
def _(spark, folder):
    copies = repeat_channels(tables.embedding_pixels(spark, folder), 3)
    return copies.select("gene_idx", "px", "py", "channel", r6("value").alias("value"))


@query(
    "flatten_pos",
    "SELECT gene_idx, px, py, CAST(px * 8 + py AS INTEGER) AS pos, px AS back_row, py AS back_col FROM e_pixels",
)
def _(spark, folder):
    pixels = tables.embedding_pixels(spark, folder).withColumn("pos", scalars.flatten_pos(F.col("px"), F.col("py"), 8))
    row, col = scalars.unflatten_pos(F.col("pos"), 8)
    return pixels.select("gene_idx", "px", "py", "pos", row.alias("back_row"), col.alias("back_col"))


@query("any_nonzero", "SELECT l_orderkey, l_linenumber, (l_discount <> 0 OR l_tax <> 0) AS usable FROM lineitem")
def _(spark, folder):
    rows = tables.table(spark, folder, "lineitem")
    usable = arrays.any_nonzero(F.array("l_discount", "l_tax"))
    return rows.select("l_orderkey", "l_linenumber", usable.alias("usable"))


@query("where_masked", "SELECT event_id, CASE WHEN value > 100 THEN user_id ELSE -1 END AS picked FROM events")
def _(spark, folder):
    rows = tables.table(spark, folder, "events")
    picked = scalars.where_masked(F.col("value") > 100, F.col("user_id"), F.lit(-1).cast("long"))
    return rows.select("event_id", picked.alias("picked"))
