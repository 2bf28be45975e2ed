"""Queries for count-matrix features, sampling and the codebook."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotgrid.catalog import inputs
from spotgrid.catalog.registry import R6, U, part, query, r6
from spotgrid.functions.keyed import uniform
from spotgrid.operators import codebook, matrix, sampling
from spotgrid.sources import tables

DIM = 6

# Cells are suppliers; a lookup of one vector per cell with keyed uniform entries.
part("m_cells", "SELECT CAST(s_suppkey AS INTEGER) AS cell_idx FROM supplier")
part(
    "m_emb",
    f"""SELECT cell_idx, CAST(d AS INTEGER) AS d, (2.0 * {U(5, 'cell_idx', 'd')} - 1.0) * sqrt(6.0 / ((SELECT count(*) FROM m_cells) + {DIM})) AS v
    FROM m_cells, (SELECT unnest(range({DIM})) AS d)""",
)
part(
    "m_weights",
    f"""SELECT cell_idx, CAST(d AS INTEGER) AS k, (2.0 * {U(9, 'cell_idx', 'd')} - 1.0) * sqrt(6.0 / ((SELECT count(*) FROM m_cells) + 4)) AS w
    FROM m_cells, (SELECT unnest(range(4)) AS d)""",
)
part(
    "m_context",
    f"""SELECT gene_idx, cell_idx, d AS channel, v FROM t_scrna JOIN m_emb USING (cell_idx)
    UNION ALL SELECT gene_idx, cell_idx, {DIM}, cnt FROM t_scrna""",
)
part("e_tokvec", f"SELECT code_id AS token_id, CAST(d AS INTEGER) AS d, {U(3, 'code_id', 'd')} AS v FROM e_codebook, (SELECT unnest(range({DIM})) AS d)")


def _cells(spark, folder):
    return tables.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("int").alias("cell_idx"))


def _emb(spark, folder):
    return matrix.cell_embedding(_cells(spark, folder), DIM, 5)


def _weights(spark, folder):
    return matrix.cell_embedding(_cells(spark, folder), 4, 9).withColumnRenamed("vec", "w")


def _keyed_vectors(rows, key, seed):
    draws = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: uniform(seed, key, d))
    return rows.select(key, draws.alias("vec"))


def _token_vectors(spark, folder):
    codes = inputs.codebook(spark, folder).select(F.col("code_id").alias("token_id"))
    return _keyed_vectors(codes, "token_id", 3)


@query("gene_index", "SELECT gene_idx, gene FROM t_genes")
def _(spark, folder):
    return tables.genes(spark, folder)


@query(
    "num_cells_genes",
    "SELECT (SELECT count(*) FROM supplier) AS num_cells, (SELECT count(*) FROM t_genes) AS num_genes",
)
def _(spark, folder):
    cells = tables.table(spark, folder, "supplier").select("s_suppkey")
    return matrix.num_cells(cells).crossJoin(F.broadcast(matrix.num_genes(tables.genes(spark, folder))))


@query(
    "gene_vectors",
    """SELECT g.gene_idx, c.cell_idx, CAST(coalesce(s.cnt, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT gene_idx FROM t_scrna) g
    CROSS JOIN (SELECT CAST(unnest(range((SELECT max(cell_idx) + 1 FROM t_scrna))) AS INTEGER) AS cell_idx) c
    LEFT JOIN t_scrna s ON s.gene_idx = g.gene_idx AND s.cell_idx = c.cell_idx""",
)
def _(spark, folder):
    counts = tables.scrna_long(spark, folder)
    width = counts.agg((F.max("cell_idx") + 1).alias("n")).first()["n"]
    vectors = matrix.gene_vectors(counts, width)
    cells = vectors.select("gene_idx", F.posexplode("counts").alias("cell_idx", "value"))
    return cells.select("gene_idx", "cell_idx", F.col("value").cast("double").alias("value"))


@query(
    "dense_counts",
    """SELECT CAST(g.page_id AS INTEGER) AS gene_idx, CAST(i AS INTEGER) AS cell_idx, CAST(coalesce(length(c.text), 0) AS DOUBLE) AS value
    FROM pages g CROSS JOIN (SELECT unnest(range((SELECT max(turn) + 1 FROM conversations))) AS i) LEFT JOIN conversations c ON c.conv_id = g.page_id AND c.turn = i""",
)
def _(spark, folder):
    genes = tables.table(spark, folder, "pages").select(F.col("page_id").cast("int").alias("gene_idx"))
    turns = tables.table(spark, folder, "conversations")
    counts = turns.select(
        F.col("conv_id").cast("int").alias("gene_idx"), F.col("turn").cast("int").alias("cell_idx"), F.length("text").cast("float").alias("count")
    )
    dense = matrix.dense_counts(counts, tables.turns(spark, folder), genes, block=3)
    return dense.select("gene_idx", "cell_idx", F.col("count").cast("double").alias("value"))


@query(
    "dense_context_mask",
    f"""SELECT CAST(g.p_partkey AS INTEGER) AS gene_idx, CAST(d AS INTEGER) AS channel, d < {DIM} OR s.l_partkey IS NOT NULL AS usable
    FROM part g CROSS JOIN (SELECT unnest(range({DIM + 1})) AS d) LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity <> 0) s ON s.l_partkey = g.p_partkey""",
)
def _(spark, folder):
    genes = tables.table(spark, folder, "part").select(F.col("p_partkey").cast("int").alias("gene_idx"))
    sold = tables.table(spark, folder, "lineitem").select(F.col("l_partkey").cast("int").alias("gene_idx"), F.col("l_quantity").alias("count"))
    return matrix.dense_context_mask(sold, _emb(spark, folder), genes, DIM)


@query("cell_embedding", f"SELECT cell_idx, d, {R6('v')} AS value FROM m_emb")
def _(spark, folder):
    cells = _emb(spark, folder).select("cell_idx", F.posexplode("vec").alias("d", "v"))
    return cells.select("cell_idx", "d", r6("v").alias("value"))


@query("embed_counts", f"SELECT gene_idx, cell_idx, channel, {R6('v')} AS value FROM m_context")
def _(spark, folder):
    context = matrix.embed_counts(tables.scrna_long(spark, folder), _emb(spark, folder))
    cells = context.select("gene_idx", "cell_idx", F.posexplode("vec").alias("channel", "v"))
    return cells.select("gene_idx", "cell_idx", "channel", r6("v").alias("value"))


@query(
    "project_counts",
    f"""SELECT gene_idx, {DIM} AS channel, k, {R6('sum(cnt * w)')} AS value FROM t_scrna JOIN m_weights USING (cell_idx) GROUP BY 1, 2, 3
    UNION ALL SELECT -1, d, k, {R6('sum(v * w)')} FROM m_emb JOIN m_weights USING (cell_idx) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    weights = _weights(spark, folder)
    counts = matrix.project_counts(tables.scrna_long(spark, folder), weights)
    shared = matrix.project_embedding(_emb(spark, folder), weights)
    counts = counts.select("gene_idx", F.lit(DIM).alias("channel"), F.posexplode("vec").alias("k", "v"))
    shared = shared.select(F.lit(-1).alias("gene_idx"), "channel", F.posexplode("vec").alias("k", "v"))
    return counts.unionByName(shared).select("gene_idx", "channel", "k", r6("v").alias("value"))


@query("context_mask", "SELECT gene_idx, channel, bool_or(v <> 0) AS usable FROM m_context GROUP BY 1, 2")
def _(spark, folder):
    return matrix.context_mask(matrix.embed_counts(tables.scrna_long(spark, folder), _emb(spark, folder)))


@query(
    "embed_tokens",
    f"""SELECT sample_id, pos, d, {R6(f"v + {U(4, 'pos', 'd')}")} AS value FROM e_tokens JOIN e_tokvec USING (token_id)""",
)
def _(spark, folder):
    tokens = inputs.tokens(spark, folder)
    positions = _keyed_vectors(tokens.select("pos").distinct(), "pos", 4)
    out = matrix.embed_tokens(tokens, _token_vectors(spark, folder), positions, inputs.CODES, inputs.SIDE**2, DIM)
    cells = out.select("sample_id", "pos", F.posexplode("vec").alias("d", "v"))
    return cells.select("sample_id", "pos", "d", r6("v").alias("value"))


@query(
    "append_context",
    f"""SELECT CAST(gene_idx AS BIGINT) AS sample_id, cell_idx AS slot, 'count' AS source, channel AS d, {R6('v')} AS value, cnt > 30 AS usable
    FROM m_context JOIN t_scrna USING (gene_idx, cell_idx) WHERE channel < {DIM}
    UNION ALL SELECT sample_id, pos, 'token', d, {R6('v')}, true FROM e_tokens JOIN e_tokvec USING (token_id)""",
)
def _(spark, folder):
    context = matrix.embed_counts(tables.scrna_long(spark, folder), _emb(spark, folder))
    base = context.select(
        F.col("gene_idx").cast("long").alias("sample_id"),
        F.col("cell_idx").alias("slot"),
        F.slice("vec", 1, DIM).alias("vec"),
        (F.get("vec", F.lit(DIM)) > 30).alias("usable"),
    )
    out = matrix.append_context(base, inputs.tokens(spark, folder), _token_vectors(spark, folder), inputs.CODES, DIM)
    cells = out.select("sample_id", "slot", "source", "usable", F.posexplode("vec").alias("d", "v"))
    return cells.select("sample_id", "slot", "source", "d", r6("v").alias("value"), "usable")


@query(
    "exact_split",
    f"""SELECT o_orderkey, CASE WHEN rk < trunc(CAST(0.95 AS DOUBLE) * n) THEN 'train' ELSE 'valid' END AS split FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY {U(3407, 'o_orderkey')}, o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)""",
)
def _(spark, folder):
    return sampling.exact_split(tables.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "shuffle_batches",
    f"""SELECT o_orderkey, rk // 32 AS batch_id, CAST(rk % 32 AS INTEGER) AS slot FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY {U(3407, 2, 'o_orderkey')}, o_orderkey) - 1 AS rk FROM orders)""",
)
def _(spark, folder):
    return sampling.shuffle_batches(tables.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 32, epoch=2)


# Steps of cycled batches: as many as these, or as two passes and what fills the last step need.
CYCLE_STEPS = 100
part(
    "n_cycle",
    f"""SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) AS batches, greatest({CYCLE_STEPS}, CAST(ceil(ceil(count(*) / 4.0) * 2 / 8.0) AS BIGINT)) * 8 AS needed FROM customer""",
)


@query(
    "cycle_batches",
    f"""SELECT CAST(seq // 8 AS BIGINT) AS step, CAST(epoch AS INTEGER) AS epoch, rk // 4 AS batch_id, CAST(rk % 4 AS INTEGER) AS slot, c_custkey FROM (
    SELECT c_custkey, epoch, rk, needed, epoch * batches + rk // 4 AS seq FROM (
    SELECT c_custkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {U(3407, 'epoch', 'c_custkey')}, c_custkey) - 1 AS rk
    FROM customer, (SELECT unnest(range(CAST(ceil(needed / greatest(batches, 1)) AS BIGINT))) AS epoch FROM n_cycle)), n_cycle) WHERE seq < needed""",
)
def _(spark, folder):
    rows = tables.table(spark, folder, "customer").select("c_custkey")
    steps = max(CYCLE_STEPS, -(-2 * -(-rows.count() // 4) // 8))
    out = sampling.cycle_batches(rows, "c_custkey", batch_size=4, steps=steps, grad_accum=8)
    return out.select("step", "epoch", "batch_id", "slot", "c_custkey")


part(
    "c_codes0",
    f"""SELECT row_number() OVER (ORDER BY d, gene_idx, prow, pcol) AS code_id, vec FROM (SELECT {U(7, 'gene_idx', 'prow', 'pcol')} AS d, gene_idx, prow, pcol,
    [v0, v1, v2, v3] AS vec FROM e_patches WHERE v0 <> 0 OR v1 <> 0 OR v2 <> 0 OR v3 <> 0 ORDER BY 1, 2, 3, 4 LIMIT 15)""",
)
for _round in range(codebook.ROUNDS):
    part(
        f"c_near{_round}",
        f"""SELECT * FROM (SELECT p.*, c.code_id, row_number() OVER (PARTITION BY gene_idx, prow, pcol
        ORDER BY round(list_cosine_similarity([v0, v1, v2, v3], c.vec), 9) DESC, c.code_id) AS rn FROM e_patches p CROSS JOIN c_codes{_round} c
        WHERE v0 <> 0 OR v1 <> 0 OR v2 <> 0 OR v3 <> 0) WHERE rn = 1""",
    )
    part(
        f"c_codes{_round + 1}",
        f"""SELECT code_id, coalesce(m.vec, c.vec) AS vec FROM c_codes{_round} c LEFT JOIN
        (SELECT code_id, [avg(v0), avg(v1), avg(v2), avg(v3)] AS vec FROM c_near{_round} GROUP BY 1) m USING (code_id)""",
    )


@query(
    "fit_codebook",
    f"""SELECT CAST(code_id AS INTEGER) AS code_id, CAST(d - 1 AS INTEGER) AS d, {R6('vec[d]')} AS value
    FROM (SELECT 0 AS code_id, [CAST(0 AS DOUBLE), 0, 0, 0] AS vec UNION ALL SELECT code_id, vec FROM c_codes{codebook.ROUNDS}), (SELECT unnest([1, 2, 3, 4]) AS d)""",
)
def _(spark, folder):
    learned = codebook.fit_codebook(inputs.patches(spark, folder), k=16, seed=7)
    cells = learned.select("code_id", F.posexplode("vec").alias("d", "v"))
    return cells.select("code_id", "d", r6("v").alias("value"))


@query("assign_codes", f"SELECT gene_idx, prow, pcol, code_id, {R6('sim')} AS sim FROM e_codes")
def _(spark, folder):
    return inputs.assigned(spark, folder).select("gene_idx", "prow", "pcol", "code_id", r6("sim").alias("sim"))


_SQUARES = " + ".join(f"(v{i} - cvec[{i + 1}]) * (v{i} - cvec[{i + 1}])" for i in range(4))


@query("commitment_loss", f"SELECT {R6(f'0.25 * sum({_SQUARES}) / (count(*) * 4)')} AS loss FROM e_codes")
def _(spark, folder):
    loss = codebook.commitment_loss(
        inputs.assigned(spark, folder), inputs.codebook(spark, folder), 0.25, inputs.CODES, 4
    )
    return loss.select(r6("loss").alias("loss"))


@query(
    "ema_update",
    "SELECT code_id, d, "
    + R6("0.8 + (1.0 - 0.8) * coalesce(n, 0)")
    + " AS n, "
    + R6("(0.8 * c + (1.0 - 0.8) * coalesce(s, 0)) / (0.8 + (1.0 - 0.8) * coalesce(n, 0))")
    + """ AS value FROM (SELECT code_id, CAST(unnest(range(4)) AS INTEGER) AS d, unnest(cvec) AS c FROM e_codebook)
    LEFT JOIN (SELECT code_id, d, count(*) AS n, sum([v0, v1, v2, v3][d + 1]) AS s FROM e_codes, (SELECT CAST(unnest(range(4)) AS INTEGER) AS d) GROUP BY 1, 2) USING (code_id, d)""",
)
def _(spark, folder):
    book = inputs.codebook(spark, folder)
    state = book.select("code_id", F.lit(1.0).alias("n"), F.col("vec").alias("total"))
    updated = codebook.ema_update(state, inputs.assigned(spark, folder))
    cells = updated.select("code_id", r6("n").alias("n"), F.posexplode("vec").alias("d", "v"))
    return cells.select("code_id", "d", "n", r6("v").alias("value"))


@query(
    "decode_from_ids",
    f"""SELECT sample_id, pos, CAST(d AS INTEGER) AS d, {R6('v')} AS value FROM (SELECT sample_id, pos, unnest(range(4)) AS d, unnest(cvec) AS v
    FROM e_tokens JOIN e_codebook ON code_id = token_id)""",
)
def _(spark, folder):
    out = codebook.decode_from_ids(inputs.tokens(spark, folder), inputs.codebook(spark, folder), inputs.CODES, 4)
    cells = out.select("sample_id", "pos", F.posexplode("vec").alias("d", "v"))
    return cells.select("sample_id", "pos", "d", r6("v").alias("value"))


@query("tokenize", "SELECT sample_id, pos, token_id FROM e_tokens")
def _(spark, folder):
    return codebook.tokenize(
        tables.embedding_pixels(spark, folder), inputs.codebook(spark, folder), inputs.SIZE, inputs.LAYERS
    )


@query("detokenize", f"SELECT CAST(gene_idx AS BIGINT) AS gene_idx, px, py, {R6('value')} AS value FROM e_recon")
def _(spark, folder):
    return inputs.recon(spark, folder).select("gene_idx", "px", "py", r6("value").alias("value"))
