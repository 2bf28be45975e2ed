"""Queries for losses and training metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotgrid.catalog import inputs
from spotgrid.catalog.registry import R6, part, query, r6
from spotgrid.operators import losses, tracking
from spotgrid.sources import tables

part("l_pairs", "SELECT l_discount * 40.0 - 2.0 AS fake, l_tax * 50.0 - 2.0 AS rl FROM lineitem")
part("e_cellcount", "SELECT count(DISTINCT gene_idx) * 64 AS n FROM e_pixels")


def _loss(df):
    return df.select(r6("loss").alias("loss"))


def _recon(kind: str) -> str:
    gap = "coalesce(a.value, 0) - coalesce(b.value, 0)"
    size = f"abs({gap})" if kind == "l1" else f"({gap}) * ({gap})"
    total = f"sum({size}) / (SELECT n FROM e_cellcount)"
    return f"""SELECT {R6(total)} AS loss FROM (SELECT gene_idx, px, py, CAST(value AS DOUBLE) AS value FROM e_pixels) a
    FULL JOIN e_recon b ON a.gene_idx = b.gene_idx AND a.px = b.px AND a.py = b.py"""


def _recon_query(kind: str):
    def run(spark, folder):
        pixels = tables.embedding_pixels(spark, folder)
        cells = pixels.agg((F.countDistinct("gene_idx") * 64).alias("_cells"))
        gap = losses.recon_loss(pixels, inputs.recon(spark, folder), 1, kind)
        return gap.crossJoin(F.broadcast(cells)).select(r6(F.col("loss") / F.col("_cells")).alias("loss"))

    return run


query("recon_loss_l1", _recon("l1"))(_recon_query("l1"))
query("recon_loss_l2", _recon("l2"))(_recon_query("l2"))


@query(
    "hinge_losses",
    f"SELECT {R6('avg(greatest(1 + fake, 0) + greatest(1 - rl, 0))')} AS discr, {R6('-avg(fake)')} AS gen FROM l_pairs",
)
def _(spark, folder):
    pairs = tables.logit_pairs(spark, folder)
    discr = losses.hinge_discr(pairs).select(r6("loss").alias("discr"))
    return discr.crossJoin(losses.hinge_gen(pairs).select(r6("loss").alias("gen")))


@query(
    "bce_losses",
    f"""SELECT {R6('avg(-ln(1 - sf + 1e-10) - ln(sr + 1e-10))')} AS discr, {R6('-avg(ln(sf + 1e-10))')} AS gen
    FROM (SELECT 1.0 / (1.0 + exp(-fake)) AS sf, 1.0 / (1.0 + exp(-rl)) AS sr FROM l_pairs)""",
)
def _(spark, folder):
    pairs = tables.logit_pairs(spark, folder)
    discr = losses.bce_discr(pairs).select(r6("loss").alias("discr"))
    return discr.crossJoin(losses.bce_gen(pairs).select(r6("loss").alias("gen")))


@query(
    "bce_with_logits",
    f"""SELECT {R6('avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))')} AS loss
    FROM (SELECT n_chars / 1000.0 - 2.0 AS z, CAST(quality AS DOUBLE) AS y FROM labels JOIN documents USING (doc_id))""",
)
def _(spark, folder):
    return _loss(losses.bce_with_logits(tables.labelled_logits(spark, folder)))


@query(
    "feature_mse",
    f"""SELECT {R6('sum((a - m) * (a - m)) / count(*)')} AS loss FROM (SELECT CAST(value AS DOUBLE) AS a,
    avg(CAST(value AS DOUBLE)) OVER (PARTITION BY label, pos) AS m FROM e_cells JOIN embeddings ON vec_id = gene_idx)""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("vec"))
    cells = rows.select("label", F.posexplode("vec").alias("d", "v"))
    means = cells.groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("s"))
    centres = packed.select("label", F.col("s.m").alias("vec"))
    near = rows.select("key", "label").join(centres, "label").select("key", "vec")
    return _loss(losses.feature_mse(rows, near))


@query(
    "combined_loss",
    f"""SELECT l_orderkey, {R6('sum(l_discount + least(l_tax / greatest(l_discount, 1e-8), 1e4) * l_tax)')} AS loss FROM lineitem GROUP BY 1""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    weight = losses.adaptive_weight(F.col("l_tax"), F.col("l_discount"))
    terms = F.array(
        F.struct(F.col("l_discount").alias("value"), F.lit(1.0).alias("weight")),
        F.struct(F.col("l_tax").alias("value"), weight.alias("weight")),
    )
    long = rows.select("l_orderkey", F.inline(terms))
    return losses.combined_loss(long, ["l_orderkey"]).select("l_orderkey", r6("loss").alias("loss"))


@query(
    "accumulate_metrics",
    f"SELECT CAST(event_id // 8 AS BIGINT) AS step, event_type AS key, {R6('sum(value / 8)')} AS value FROM events GROUP BY 1, 2",
)
def _(spark, folder):
    out = tracking.accumulate_metrics(tables.event_metrics(spark, folder, 8), 8)
    return out.select("step", "key", r6("value").alias("value"))


@query(
    "epoch_validation",
    f"""SELECT * FROM (SELECT CAST(step // 13 + 1 AS BIGINT) AS epoch, CAST((step // 13 + 1) * 13 - 1 AS BIGINT) AS last_step, {R6('avg(value)')} AS val_loss
    FROM (SELECT event_id // 5 AS step, value FROM events) GROUP BY 1, 2)
    WHERE last_step <= (SELECT max(event_id // 5) FROM events)""",
)
def _(spark, folder):
    losses_by_step = tables.event_metrics(spark, folder, 5).select("step", "value")
    out = tracking.epoch_validation(losses_by_step, batch_size=4, batches=50)
    return out.select("epoch", "last_step", r6("val_loss").alias("val_loss"))


@query(
    "ema_by_key",
    f"""WITH RECURSIVE seen AS (SELECT event_type AS k, event_id AS stp, ln(1 + value) AS v,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
    upd AS (SELECT k, stp, v, row_number() OVER (PARTITION BY k ORDER BY stp) AS j FROM seen WHERE stp % 3 = 0),
    run(k, j, stp, e) AS (SELECT k, j, stp, v FROM upd WHERE j = 1
        UNION ALL SELECT u.k, u.j, u.stp, CASE WHEN u.stp <= 60 THEN u.v ELSE 0.9 * r.e + (1.0 - 0.9) * u.v END
        FROM run r JOIN upd u ON u.k = r.k AND u.j = r.j + 1)
    SELECT s.k AS event_type, s.stp AS event_id, {R6('r.e')} AS ema FROM seen s ASOF LEFT JOIN run r ON s.k = r.k AND s.stp >= r.stp""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "events").select("event_type", "event_id", F.log1p("value").alias("value"))
    out = tracking.ema_by_key(rows, "event_type", "event_id", "value", beta=0.9, update_after=60, update_every=3)
    return out.select("event_type", "event_id", r6("ema").alias("ema"))
