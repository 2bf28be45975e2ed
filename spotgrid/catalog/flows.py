"""Queries for whole flows: codec refinement, scorer training and generation of expression maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotgrid.catalog import inputs
from spotgrid.catalog.registry import R6, U, part, query, r6
from spotgrid.operators import generating, matrix, raster, scoring
from spotgrid.operators.codebook import fit_codebook
from spotgrid.operators.raster import patch_vectors
from spotgrid.plans.dataset import gene_conditions
from spotgrid.plans.session import cut_lineage, shared_folder
from spotgrid.plans.training import flow_steps, refine_codebook, train_codec, train_flow, train_scorer
from spotgrid.sources import tables

ROUNDS = 3
_GAP = " + ".join(f"(v{i} - vec[{i + 1}]) * (v{i} - vec[{i + 1}])" for i in range(4))
_BLEND = ", ".join(f"0.8 * total[{i}] + (1.0 - 0.8) * coalesce(s[{i}], 0)" for i in range(1, 5))
_VECS = ", ".join(f"sum(v{i})" for i in range(4))

part("f_state0", "SELECT code_id, CAST(1 AS DOUBLE) AS n, cvec AS total, cvec AS vec FROM e_codebook")
for _round in range(ROUNDS):
    part(
        f"f_assigned{_round}",
        f"""SELECT * FROM (SELECT p.*, s.code_id, s.vec, row_number() OVER (PARTITION BY gene_idx, prow, pcol
        ORDER BY round(list_cosine_similarity([v0, v1, v2, v3], s.vec), 9) DESC, s.code_id) AS rn FROM e_patches p CROSS JOIN f_state{_round} s) WHERE rn = 1""",
    )
    part(
        f"f_state{_round + 1}",
        f"""SELECT code_id, n, total, [total[1] / n, total[2] / n, total[3] / n, total[4] / n] AS vec FROM (
        SELECT code_id, 0.8 * n + (1.0 - 0.8) * coalesce(m, 0) AS n, [{_BLEND}] AS total
        FROM f_state{_round} LEFT JOIN (SELECT code_id, count(*) AS m, [{_VECS}] AS s FROM f_assigned{_round} GROUP BY 1) USING (code_id))""",
    )


@query(
    "refine_codebook",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step, {R6(f'sum({_GAP}) / (count(*) * 4)')} AS value FROM f_assigned{i}" for i in range(ROUNDS)
    ),
)
def _(spark, folder):
    blocks = cut_lineage(inputs.patches(spark, folder))
    _, metrics = refine_codebook(blocks, inputs.codebook(spark, folder, blocks), ROUNDS)
    return metrics.select("step", r6("value").alias("value"))


part(
    "v_split",
    f"""SELECT sample_id, cond, rk < trunc(CAST(0.75 AS DOUBLE) * n) AS train FROM (SELECT sample_id, cond, count(*) OVER () AS n,
    row_number() OVER (ORDER BY {U(5, 'sample_id')}, sample_id) - 1 AS rk FROM e_cond)""",
)
part("v_seen", "SELECT cond, pos, token_id, count(*) AS n FROM e_tokens JOIN v_split USING (sample_id) WHERE train GROUP BY 1, 2, 3")
part("v_null", "SELECT pos, token_id, sum(n) AS n FROM v_seen GROUP BY 1, 2")
part("v_vocab", f"SELECT CAST(unnest(range({inputs.CODES})) AS INTEGER) AS token_id")
part("v_prior", f"SELECT token_id, (coalesce(sum(n), 0) + 1) / ((SELECT sum(n) FROM v_seen) + {inputs.CODES}) AS p FROM v_vocab LEFT JOIN v_seen USING (token_id) GROUP BY 1")
part(
    "v_hidden",
    f"""SELECT sample_id, pos, token_id, cond FROM (SELECT sample_id, pos, token_id, cond, count(*) OVER (PARTITION BY sample_id) AS n,
    row_number() OVER (PARTITION BY sample_id ORDER BY {U(5, 'sample_id', 'pos')}, pos) - 1 AS rk
    FROM e_tokens JOIN v_split USING (sample_id) WHERE NOT train) WHERE rk < greatest(round_even(cos({U(5, 'sample_id')} * pi() * 0.5) * n, 0), 1.0)""",
)
part(
    "v_dense",
    """SELECT h.sample_id, h.pos, h.token_id AS label, t.token_id, ln(coalesce(u.n, 0) + p) AS bare,
    ln(CASE WHEN k.cond IS NULL THEN coalesce(u.n, 0) ELSE coalesce(c.n, 0) END + p) AS own
    FROM v_hidden h CROSS JOIN v_prior t LEFT JOIN (SELECT DISTINCT cond, pos FROM v_seen) k ON k.cond = h.cond AND k.pos = h.pos
    LEFT JOIN v_seen c ON c.cond = h.cond AND c.pos = h.pos AND c.token_id = t.token_id LEFT JOIN v_null u ON u.pos = h.pos AND u.token_id = t.token_id""",
)
part(
    "v_rated",
    """SELECT sample_id, pos, ln(sum(exp(bare + (own - bare) * 1.5))) - max(CASE WHEN token_id = label THEN bare + (own - bare) * 1.5 END) AS ce
    FROM v_dense GROUP BY 1, 2""",
)


@query("train_scorer", f"SELECT {R6('avg(ce)')} AS loss FROM v_rated")
def _(spark, folder):
    tokens = cut_lineage(inputs.tokens(spark, folder))
    _, loss = train_scorer(tokens, tables.embedding_conditions(spark, folder), inputs.CODES, 1.0, valid_frac=0.25, seed=5, scale=1.5)
    return loss.select(r6("loss").alias("loss"))


CODEC_STEPS, CODEC_ACCUM = 4, 2
_BATCHES = CODEC_STEPS * CODEC_ACCUM
part(
    "x_batch",
    f"""SELECT greatest(1, CAST(ceil(count(*) / {_BATCHES}.0) AS BIGINT)) AS b, CAST(ceil(count(*) / greatest(1, ceil(count(*) / {_BATCHES}.0))) AS BIGINT) AS per FROM v_split WHERE train""",
)
part(
    "x_plan",
    f"""SELECT CAST(sample_id AS INTEGER) AS gene_idx, epoch * per + rk // b AS batch FROM (
    SELECT sample_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {U(5, 'epoch', 'sample_id')}, sample_id) - 1 AS rk
    FROM v_split CROSS JOIN (SELECT unnest(range(CAST(ceil({_BATCHES}.0 / per) AS BIGINT))) AS epoch FROM x_batch) WHERE train) CROSS JOIN x_batch WHERE epoch * per + rk // b < {_BATCHES}""",
)
part("x_state0", "SELECT * FROM f_state0")
for _step in range(CODEC_STEPS):
    part(
        f"x_assigned{_step}",
        f"""SELECT * FROM (SELECT p.*, l.batch, s.code_id, s.vec, row_number() OVER (PARTITION BY p.gene_idx, prow, pcol, l.batch
        ORDER BY round(list_cosine_similarity([v0, v1, v2, v3], s.vec), 9) DESC, s.code_id) AS rn
        FROM e_patches p JOIN x_plan l ON l.gene_idx = p.gene_idx AND l.batch // {CODEC_ACCUM} = {_step} CROSS JOIN x_state{_step} s) WHERE rn = 1""",
    )
    part(
        f"x_state{_step + 1}",
        f"""SELECT code_id, n, total, [total[1] / n, total[2] / n, total[3] / n, total[4] / n] AS vec FROM (
        SELECT code_id, 0.8 * n + (1.0 - 0.8) * coalesce(m, 0) AS n, [{_BLEND}] AS total
        FROM x_state{_step} LEFT JOIN (SELECT code_id, count(*) AS m, [{_VECS}] AS s FROM x_assigned{_step} GROUP BY 1) USING (code_id))""",
    )


def _held_out_sql(step: int) -> str:
    """Gap of the hold-out's blocks after a step."""
    return f"""SELECT CAST({step} AS BIGINT) AS step, 'valid' AS key, {R6(f'sum({_GAP}) / (count(*) * 4)')} AS value FROM (
    SELECT p.*, s.vec, row_number() OVER (PARTITION BY gene_idx, prow, pcol ORDER BY round(list_cosine_similarity([v0, v1, v2, v3], s.vec), 9) DESC, s.code_id) AS rn
    FROM e_patches p JOIN v_split v ON v.sample_id = p.gene_idx AND NOT v.train CROSS JOIN x_state{step + 1} s) WHERE rn = 1"""


@query(
    "train_codec",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step, 'loss' AS key, {R6('avg(m)')} AS value FROM (SELECT sum({_GAP}) / (count(*) * 4) AS m FROM x_assigned{i} GROUP BY batch)"
        for i in range(CODEC_STEPS)
    )
    + " UNION ALL "
    + " UNION ALL ".join(map(_held_out_sql, (0, CODEC_STEPS - 1))),
)
def _(spark, folder):
    pixels = cut_lineage(tables.embedding_pixels(spark, folder))
    genes = tables.embedding_conditions(spark, folder).select(F.col("sample_id").cast("int").alias("gene_idx"))
    batch = max(1, -(-int(0.75 * genes.count()) // _BATCHES))
    start = inputs.codebook(spark, folder)
    results = shared_folder(spark, "codec")
    _, metrics = train_codec(pixels, genes, start, inputs.SIZE, inputs.LAYERS, CODEC_STEPS, batch, results, CODEC_ACCUM, valid_frac=0.25, seed=5)
    return metrics.where("key <> 'valid_l1'").select("step", "key", r6("value").alias("value"))


FLOW_BATCH, FLOW_PASSES = 32, 2.4
part(
    "y_batches",
    f"""SELECT per_epoch, greatest(1, CAST(ceil(CAST({FLOW_PASSES} AS DOUBLE) * per_epoch) AS BIGINT)) AS steps
    FROM (SELECT CAST(ceil(count(*) / {FLOW_BATCH}.0) AS BIGINT) AS per_epoch FROM v_split WHERE train)""",
)
part("y_epochs", "SELECT unnest(range(CAST(ceil(steps / per_epoch) AS BIGINT))) AS epoch FROM y_batches")
part(
    "y_plan",
    f"""SELECT epoch, sample_id, CASE WHEN CAST('0x' || substr(md5((5 + epoch) || ':' || sample_id), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) < 0.75 THEN cond ELSE -1 END AS cond
    FROM (SELECT epoch, sample_id, cond, row_number() OVER (PARTITION BY epoch ORDER BY {U(5, 'epoch', 'sample_id')}, sample_id) - 1 AS rk
    FROM v_split CROSS JOIN y_epochs WHERE train) CROSS JOIN y_batches WHERE epoch * per_epoch + rk // {FLOW_BATCH} < steps""",
)
part("y_counts", "SELECT epoch, cond, pos, token_id, count(*) AS n FROM y_plan JOIN e_tokens USING (sample_id) GROUP BY 1, 2, 3, 4")
part(
    "y_seen",
    """SELECT e.epoch, cond, pos, token_id, sum(n) AS n FROM y_epochs e JOIN y_counts c ON c.epoch <= e.epoch CROSS JOIN y_batches
    WHERE (e.epoch + 1) * per_epoch <= steps GROUP BY 1, 2, 3, 4""",
)
part("y_null", "SELECT epoch, pos, token_id, sum(n) AS n FROM y_seen GROUP BY 1, 2, 3")
part("y_total", "SELECT epoch, sum(n) AS n FROM y_seen GROUP BY 1")
part("y_token", "SELECT epoch, token_id, sum(n) AS n FROM y_seen GROUP BY 1, 2")
part(
    "y_prior",
    f"SELECT t.epoch, v.token_id, (coalesce(k.n, 0) + 1) / (t.n + {inputs.CODES}) AS p FROM y_total t CROSS JOIN v_vocab v LEFT JOIN y_token k ON k.epoch = t.epoch AND k.token_id = v.token_id",
)
part(
    "y_dense",
    """SELECT t.epoch, h.sample_id, h.pos, h.token_id AS label, t.token_id, ln(coalesce(u.n, 0) + p) AS bare,
    ln(CASE WHEN k.cond IS NULL THEN coalesce(u.n, 0) ELSE coalesce(c.n, 0) END + p) AS own
    FROM v_hidden h CROSS JOIN y_prior t LEFT JOIN (SELECT DISTINCT epoch, cond, pos FROM y_seen WHERE cond <> -1) k ON k.epoch = t.epoch AND k.cond = h.cond AND k.pos = h.pos
    LEFT JOIN y_seen c ON c.epoch = t.epoch AND c.cond = h.cond AND c.pos = h.pos AND c.token_id = t.token_id
    LEFT JOIN y_null u ON u.epoch = t.epoch AND u.pos = h.pos AND u.token_id = t.token_id""",
)
part(
    "y_rated",
    """SELECT epoch, sample_id, pos, ln(sum(exp(bare + (own - bare) * 1.5))) - max(CASE WHEN token_id = label THEN bare + (own - bare) * 1.5 END) AS ce
    FROM y_dense GROUP BY 1, 2, 3""",
)


@query(
    "train_flow",
    f"""SELECT (epoch + 1) * per_epoch - 1 AS step, CAST(epoch + 1 AS INTEGER) AS epoch, 'valid' AS key, {R6('avg(ce)')} AS value FROM y_rated CROSS JOIN y_batches GROUP BY epoch, per_epoch
    UNION ALL SELECT max(steps) - 1, NULL, 'told', CAST(sum(n) AS DOUBLE) FROM y_counts CROSS JOIN y_batches WHERE cond <> -1""",
)
def _(spark, folder):
    tokens = cut_lineage(inputs.tokens(spark, folder))
    conditions = tables.embedding_conditions(spark, folder)
    settings = dict(valid_frac=0.25, seed=5, scale=1.5, dropout=0.25)
    steps = flow_steps(conditions, FLOW_BATCH, FLOW_PASSES, settings["valid_frac"])
    scorer, metrics = train_flow(tokens, conditions, inputs.CODES, steps, FLOW_BATCH, shared_folder(spark, "flow"), **settings)
    told = scorer.seen.where(F.col("cond") != scoring.NULL_COND).agg(F.sum("n").cast("double").alias("value"))
    told = told.select(F.lit(steps - 1).cast("long").alias("step"), F.lit(None).cast("int").alias("epoch"), F.lit("told").alias("key"), "value")
    return metrics.withColumn("value", r6("value")).unionByName(told)


@query("expression_generation")
def _(spark, folder):
    """Expression maps generated from count vectors, with everything fitted on the tables."""
    pixels = cut_lineage(raster.rasterize(tables.spots(spark, folder), tables.insitu_long(spark, folder), 16))
    counts = cut_lineage(tables.scrna_long(spark, folder))
    cells = tables.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("int").alias("cell_idx"))
    weights = matrix.cell_embedding(cells, 8, 9).withColumnRenamed("vec", "w")
    genes = tables.genes(spark, folder)
    samples = cut_lineage(gene_conditions(counts, weights, 4, seed=2, genes=genes))
    codec = generating.Codec(cut_lineage(fit_codebook(patch_vectors(pixels, 16, 2), 24, seed=3)), 24, 16, 2)
    scorer = scoring.fit_token_scorer(cut_lineage(codec.encode(pixels, samples)), samples)
    run = generating.Decoding(codec.side, codec.codes, seed=6)
    image = codec.decode(generating.generate(samples, scorer, run))
    return image.select("gene_idx", "px", "py", r6("value").alias("value"))
