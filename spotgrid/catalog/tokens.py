"""Queries for token masking, scoring, decoding, generation and soft lookup."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from spotgrid.catalog import inputs
from spotgrid.catalog.registry import GUMBEL, R6, U, part, query, r6
from spotgrid.functions.keyed import uniform
from spotgrid.operators import decoding, generating, losses, lookup, masking, scoring
from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import join_shared
from spotgrid.sources import tables

MASK = inputs.CODES
KEPT = decoding.kept_logits(inputs.CODES)

part(
    "k_ranked",
    f"""SELECT sample_id, pos, token_id, {U(7, 'sample_id')} AS t, count(*) OVER (PARTITION BY sample_id) AS n,
    row_number() OVER (PARTITION BY sample_id ORDER BY {U(7, 'sample_id', 'pos')}, pos) - 1 AS rk FROM e_tokens""",
)
part(
    "k_hidden",
    "SELECT sample_id, pos, token_id, rk < greatest(round_even(cos(t * pi() * 0.5) * n, 0), 1.0) AS masked FROM k_ranked",
)
part(
    "k_masked",
    f"""SELECT sample_id, pos, token_id, masked, CASE WHEN masked THEN token_id ELSE -1 END AS label,
    CASE WHEN masked THEN {MASK} ELSE token_id END AS x FROM k_hidden""",
)
part("s_seen", "SELECT cond, pos, token_id, count(*) AS n FROM e_tokens JOIN e_cond USING (sample_id) GROUP BY 1, 2, 3")
part("s_prior", "SELECT token_id, sum(n) / (SELECT sum(n) FROM s_seen) AS p FROM s_seen GROUP BY 1")
part("s_cond", "SELECT cond, pos, token_id, ln(n + 0.5 * p) AS logit FROM s_seen JOIN s_prior USING (token_id)")
part(
    "s_null",
    "SELECT pos, token_id, ln(n + 0.5 * p) AS logit FROM (SELECT pos, token_id, sum(n) AS n FROM s_seen GROUP BY 1, 2) JOIN s_prior USING (token_id)",
)
part(
    "k_scored",
    """SELECT k.sample_id, k.pos, c.token_id, c.logit AS cond_logit, u.logit AS null_logit FROM k_masked k
    JOIN e_cond USING (sample_id) JOIN s_cond c ON c.cond = e_cond.cond AND c.pos = k.pos
    JOIN s_null u ON u.pos = c.pos AND u.token_id = c.token_id WHERE k.masked""",
)
part("k_logits", "SELECT sample_id, pos, token_id, null_logit + (cond_logit - null_logit) * 3 AS logit FROM k_scored")
part(
    "k_kept",
    f"""SELECT sample_id, pos, token_id, logit FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pos
    ORDER BY round(logit, 9) DESC, token_id) AS rk FROM k_logits) WHERE rk <= {KEPT}""",
)
part(
    "k_pred",
    f"""SELECT sample_id, pos, token_id AS pred_id FROM (SELECT sample_id, pos, token_id, row_number() OVER (PARTITION BY sample_id, pos
    ORDER BY logit / 0.5 + {GUMBEL(U(21, 'sample_id', 'pos', 'token_id'))} DESC, token_id) AS rk FROM k_kept) WHERE rk = 1""",
)


class Flow:
    """Steps that several queries need; tokens are written once per query and then re-read."""

    def __init__(self, spark, folder):
        self.conditions = tables.embedding_conditions(spark, folder)
        self._source = lambda: inputs.tokens(spark, folder)

    @cached_property
    def tokens(self):
        return cut_lineage(self._source())

    @cached_property
    def masked(self):
        return masking.mask_tokens(self.tokens, MASK, 7)

    @cached_property
    def scorer(self):
        return scoring.fit_token_scorer(self.tokens, self.conditions, 0.5).saved()

    @cached_property
    def guided(self):
        """Guided logits per condition and position, shared by all samples."""
        return self.scorer.guided(3.0)

    @cached_property
    def hidden(self):
        return self.masked.where("masked").join(self.conditions, "sample_id")

    @cached_property
    def kept(self):
        """Filtered per condition and position before any sample is joined."""
        kept = decoding.topk_filter(self.guided, inputs.CODES, keys=scoring.COND_KEYS)
        hidden = self.hidden.select("sample_id", "pos", "cond")
        return join_shared(hidden, kept, ["cond", "pos"]).select("sample_id", "pos", "token_id", "logit")

    @cached_property
    def pred(self):
        return decoding.gumbel_argmax(self.kept, 0.5, 21)


@query("mask_tokens", "SELECT sample_id, pos, token_id, masked, label, x FROM k_masked")
def _(spark, folder):
    flow = Flow(spark, folder)
    return flow.masked


@query(
    "mask_subset",
    f"""SELECT sample_id, pos, token_id, masked, label, CASE WHEN masked AND rk < greatest(m * CAST(0.3 AS DOUBLE), 1.0) THEN token_id ELSE x END AS x FROM (
    SELECT *, count(*) OVER (PARTITION BY sample_id, masked) AS m,
    row_number() OVER (PARTITION BY sample_id, masked ORDER BY {U(8, 'sample_id', 'pos')}, pos) - 1 AS rk FROM k_masked)""",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    return masking.mask_subset(flow.masked, 0.3, 8, min_mask=1)


@query(
    "init_canvas",
    f"SELECT vec_id AS sample_id, CAST(i AS INTEGER) AS pos, {MASK} AS token_id, CAST(0 AS DOUBLE) AS score FROM embeddings, (SELECT unnest(range(16)) AS i)",
)
def _(spark, folder):
    return masking.init_canvas(tables.embedding_conditions(spark, folder), inputs.SIDE, MASK)


@query(
    "decode_schedule",
    f"""SELECT doc_id, seq_len, CAST(i AS INTEGER) AS step, {R6('i / 17.0')} AS t, CAST(17 - i AS INTEGER) AS steps_left,
    CAST(greatest(trunc(cos(i / 17.0 * pi() * 0.5) * seq_len), 1) AS BIGINT) AS hidden, {R6('2.0 * (17 - i) / 18')} AS temp
    FROM (SELECT doc_id, n_chars AS seq_len FROM documents), (SELECT unnest(range(18)) AS i)""",
)
def _(spark, folder):
    lengths = tables.table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("seq_len"))
    steps = masking.decode_schedule(lengths, 18, 2.0)
    return steps.select("doc_id", "seq_len", "step", r6("t").alias("t"), "steps_left", "hidden", r6("temp").alias("temp"))


part("k_canvas", f"SELECT sample_id, pos, token_id, {U(13, 'sample_id', 'pos')} AS score FROM e_tokens")


@query(
    "remask_topk",
    f"""SELECT sample_id, pos, CASE WHEN rk <= 5 THEN {MASK} ELSE token_id END AS token_id, {R6('score')} AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, pos) AS rk FROM k_canvas)""",
)
def _(spark, folder):
    canvas = inputs.tokens(spark, folder).withColumn("score", uniform(13, "sample_id", "pos"))
    return masking.remask_topk(canvas, 5, MASK).select("sample_id", "pos", "token_id", r6("score").alias("score"))


@query("fit_token_scorer", f"SELECT cond, pos, token_id, {R6('logit')} AS logit FROM s_cond UNION ALL SELECT -1, pos, token_id, {R6('logit')} FROM s_null")
def _(spark, folder):
    flow = Flow(spark, folder)
    scorer = flow.scorer
    both = scorer.cond.unionByName(scorer.with_null())
    return both.select("cond", "pos", "token_id", r6("logit").alias("logit"))


@query("score_tokens", f"SELECT sample_id, pos, token_id, {R6('cond_logit')} AS cond_logit, {R6('null_logit')} AS null_logit FROM k_scored")
def _(spark, folder):
    flow = Flow(spark, folder)
    out = scoring.score_tokens(flow.hidden, flow.scorer)
    return out.select("sample_id", "pos", "token_id", r6("cond_logit").alias("cond_logit"), r6("null_logit").alias("null_logit"))


@query(
    "guide",
    f"""SELECT cond, pos, token_id, {R6('coalesce(u.logit, -9.0) + (coalesce(c.logit, -9.0) - coalesce(u.logit, -9.0)) * 3')} AS logit
    FROM s_cond c FULL JOIN (SELECT cond, pos, token_id, s_null.logit FROM (SELECT DISTINCT cond, pos FROM s_cond) JOIN s_null USING (pos)) u USING (cond, pos, token_id)""",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    null = flow.scorer.seen.select("cond", "pos").distinct().join(flow.scorer.null, "pos")
    out = decoding.guide(flow.scorer.cond, null, 3.0, floor=-9.0, keys=("cond", "pos"))
    return out.select("cond", "pos", "token_id", r6("logit").alias("logit"))


@query(
    "guide_negative",
    f"""SELECT cond, neg_cond, pos, token_id, {R6('coalesce(b.logit, -9.0) + (coalesce(a.logit, -9.0) - coalesce(b.logit, -9.0)) * 2')} AS logit
    FROM (SELECT cond, (cond + 1) % 10 AS neg_cond, pos, token_id, logit FROM s_cond) a
    FULL JOIN (SELECT (cond + 9) % 10 AS cond, cond AS neg_cond, pos, token_id, logit FROM s_cond) b USING (cond, neg_cond, pos, token_id)""",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    other = ((F.col("cond") + 1) % 10).alias("neg_cond")
    keys = ("cond", "neg_cond", "pos")
    wanted = flow.scorer.cond.select("cond", other, "pos", "token_id", "logit")
    avoided = flow.scorer.cond.select(((F.col("cond") + 9) % 10).alias("cond"), F.col("cond").alias("neg_cond"), "pos", "token_id", "logit")
    out = decoding.guide_negative(wanted, avoided, 2.0, floor=-9.0, keys=keys)
    return out.select("cond", "neg_cond", "pos", "token_id", r6("logit").alias("logit"))


@query("topk_filter", f"SELECT sample_id, pos, token_id, {R6('logit')} AS logit FROM k_kept")
def _(spark, folder):
    flow = Flow(spark, folder)
    return flow.kept.select("sample_id", "pos", "token_id", r6("logit").alias("logit"))


@query("gumbel_argmax", "SELECT sample_id, pos, pred_id FROM k_pred")
def _(spark, folder):
    flow = Flow(spark, folder)
    return flow.pred


@query(
    "fill_masked",
    f"SELECT sample_id, pos, CASE WHEN x = {MASK} AND pred_id IS NOT NULL THEN pred_id ELSE x END AS token_id FROM k_masked LEFT JOIN k_pred USING (sample_id, pos)",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    canvas = flow.masked.select("sample_id", "pos", F.col("x").alias("token_id"))
    return masking.fill_masked(canvas, flow.pred, MASK)


@query(
    "confidence_scores",
    f"""SELECT sample_id, pos, {R6('CASE WHEN masked THEN 1 - coalesce(prob, 0) ELSE -1e5 END')} AS score FROM k_masked LEFT JOIN (
    SELECT sample_id, pos, sum(CASE WHEN token_id = pred_id THEN exp(logit) ELSE 0 END) / sum(exp(logit)) AS prob
    FROM k_logits JOIN k_pred USING (sample_id, pos) GROUP BY 1, 2) USING (sample_id, pos)""",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    canvas = flow.masked.join(flow.conditions, "sample_id")
    canvas = canvas.select("sample_id", "pos", "cond", F.col("masked").alias("was_masked"))
    out = decoding.confidence_scores(canvas, flow.guided, flow.pred, keys=scoring.COND_KEYS)
    return out.select("sample_id", "pos", r6("score").alias("score"))


@query(
    "critic_scores",
    "SELECT sample_id, pos, " + R6("score + (" + U(31, 4, "sample_id", "pos") + " - 0.5) * 2.0 * 13 / 18") + " AS score FROM k_canvas",
)
def _(spark, folder):
    critic = inputs.tokens(spark, folder).withColumn("score", uniform(13, "sample_id", "pos"))
    out = decoding.critic_scores(critic, 4, 18, 31, 2.0)
    return out.select("sample_id", "pos", r6("score").alias("score"))


@query(
    "critic_labels",
    """SELECT sample_id, pos, critic_input, CAST(token_id <> critic_input AS DOUBLE) AS critic_label FROM (
    SELECT sample_id, pos, token_id, CASE WHEN masked THEN pred_id ELSE x END AS critic_input FROM k_masked LEFT JOIN k_pred USING (sample_id, pos))""",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    return masking.critic_labels(flow.masked, flow.pred)


@query(
    "condition_dropout",
    f"SELECT sample_id, pos, masked AND {U(17, 'sample_id')} < 0.75 AS usable FROM k_masked",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    context = flow.masked.select("sample_id", "pos", F.col("masked").alias("usable"))
    return masking.condition_dropout(context, 0.25, 17)


@query(
    "masked_cross_entropy",
    f"""SELECT {R6('avg(ce)')} AS loss FROM (SELECT sample_id, pos, ln(sum(exp(logit))) - max(CASE WHEN l.token_id = k.label THEN logit END) AS ce
    FROM k_masked k JOIN k_logits l USING (sample_id, pos) WHERE k.label <> -1 GROUP BY 1, 2)""",
)
def _(spark, folder):
    flow = Flow(spark, folder)
    labels = flow.masked.join(flow.conditions, "sample_id")
    out = losses.masked_cross_entropy(flow.guided, labels, keys=scoring.COND_KEYS)
    return out.select(r6("loss").alias("loss"))


part(
    "a_pairs",
    """SELECT gene_idx, prow, pcol, cvec, 8 * list_cosine_similarity([v0, v1, v2, v3], cvec) AS s FROM e_sims WHERE cvec[1] >= cvec[2]
    UNION ALL SELECT gene_idx, prow, pcol, [CAST(0.5 AS DOUBLE), 0.5, 0.5, 0.5], 8 * list_cosine_similarity([v0, v1, v2, v3], [CAST(1 AS DOUBLE), 0, 0, 0]) FROM e_patches""",
)


@query(
    "soft_lookup",
    "SELECT gene_idx, prow, pcol, "
    + ", ".join(R6(f"sum(exp(s) * cvec[{i + 1}]) / sum(exp(s))") + f" AS r{i}" for i in range(4))
    + " FROM a_pairs GROUP BY 1, 2, 3",
)
def _(spark, folder):
    queries = inputs.patches(spark, folder).select(F.struct("gene_idx", "prow", "pcol").alias("query_id"), "vec")
    usable = (F.col("vec")[0] >= F.col("vec")[1]).alias("usable")
    context = inputs.codebook(spark, folder).select(
        F.col("code_id").alias("key_id"), F.col("vec").alias("key_vec"), F.col("vec").alias("value_vec"), usable
    )
    out = lookup.soft_lookup(queries, context, [1.0, 0.0, 0.0, 0.0], [0.5] * 4)
    return out.select("query_id.*", *[r6(F.col("result")[i]).alias(f"r{i}") for i in range(4)])


def _slice_score(a: list[str], b: list[str]) -> str:
    """Scaled cosine of two slices of components; a slice of zeros scores 0."""
    length = lambda v: f"greatest(sqrt({' + '.join(f'({x}) * ({x})' for x in v)}), 1e-12)"
    return f"8 * ({' + '.join(f'({x}) * ({y})' for x, y in zip(a, b))}) / ({length(a)} * {length(b)})"


_KEYS = [f"k[{i + 1}]" for i in range(4)]
part("a_keys", "SELECT cvec AS k FROM e_codebook WHERE cvec[1] >= cvec[2]")
part(
    "a_heads",
    " UNION ALL ".join(
        f"""SELECT gene_idx, prow, pcol, {h} AS h, k[{2 * h + 1}] AS a, k[{2 * h + 2}] AS b, {_slice_score([f"v{2 * h}", f"v{2 * h + 1}"], _KEYS[2 * h : 2 * h + 2])} AS s
    FROM e_patches CROSS JOIN a_keys UNION ALL SELECT gene_idx, prow, pcol, {h}, 0.5, 0.5, {_slice_score([f"v{2 * h}", f"v{2 * h + 1}"], ["1 - " + str(h), "0"])} FROM e_patches"""
        for h in range(2)
    ),
)


@query(
    "soft_lookup_heads",
    "SELECT gene_idx, prow, pcol, "
    + ", ".join(R6(f"sum(exp(s) * {c}) FILTER (h = {h}) / sum(exp(s)) FILTER (h = {h})") + f" AS r{2 * h + i}" for h in range(2) for i, c in enumerate("ab"))
    + " FROM a_heads GROUP BY 1, 2, 3",
)
def _(spark, folder):
    queries = inputs.patches(spark, folder).select(F.struct("gene_idx", "prow", "pcol").alias("query_id"), "vec")
    usable = (F.col("vec")[0] >= F.col("vec")[1]).alias("usable")
    context = inputs.codebook(spark, folder).select(
        F.col("code_id").alias("key_id"), F.col("vec").alias("key_vec"), F.col("vec").alias("value_vec"), usable
    )
    out = lookup.soft_lookup(queries, context, [1.0, 0.0, 0.0, 0.0], [0.5] * 4, heads=2)
    return out.select("query_id.*", *[r6(F.col("result")[i]).alias(f"r{i}") for i in range(4)])


part(
    "a_own",
    f"""SELECT q.gene_idx, q.prow, q.pcol, [c.v0, c.v1, c.v2, c.v3] AS k, {_slice_score([f"q.v{i}" for i in range(4)], [f"c.v{i}" for i in range(4)])} AS s
    FROM e_patches q JOIN e_patches c USING (gene_idx) WHERE c.prow >= c.pcol
    UNION ALL SELECT gene_idx, prow, pcol, [CAST(0.5 AS DOUBLE), 0.5, 0.5, 0.5], {_slice_score([f"v{i}" for i in range(4)], ["1", "0", "0", "0"])} FROM e_patches""",
)


@query(
    "soft_lookup_own",
    "SELECT gene_idx, prow, pcol, " + ", ".join(R6(f"sum(exp(s) * k[{i + 1}]) / sum(exp(s))") + f" AS r{i}" for i in range(4)) + " FROM a_own GROUP BY 1, 2, 3",
)
def _(spark, folder):
    patches = cut_lineage(inputs.patches(spark, folder))
    place = F.struct("gene_idx", "prow", "pcol")
    queries = patches.select(place.alias("query_id"), "vec", "gene_idx")
    usable = (F.col("prow") >= F.col("pcol")).alias("usable")
    context = patches.select(place.alias("key_id"), F.col("vec").alias("key_vec"), F.col("vec").alias("value_vec"), usable, "gene_idx")
    out = lookup.soft_lookup(queries, context, [1.0, 0.0, 0.0, 0.0], [0.5] * 4, by="gene_idx")
    return out.select("query_id.*", *[r6(F.col("result")[i]).alias(f"r{i}") for i in range(4)])


def _canvas_sql(timesteps: int, seed: int) -> str:
    """Unrolled SQL of the decoding loop over the candidate table."""
    for step in masking.schedule_steps(inputs.SIDE**2, timesteps):
        before = f"g_step{step.index - 1}" if step.index else "g_start"
        noise = GUMBEL(U(seed, step.index, "sample_id", "pos", "token_id"))
        part(
            f"g_hide{step.index}",
            f"""SELECT sample_id, pos, cond, token_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, pos) <= {step.hidden} AS hide FROM {before}""",
        )
        part(
            f"g_pick{step.index}",
            f"""SELECT sample_id, pos, token_id AS pred, prob FROM (SELECT sample_id, pos, token_id, prob, row_number() OVER (PARTITION BY sample_id, pos
            ORDER BY logit / {max(step.temperature, 1e-10)!r}::DOUBLE + {noise} DESC, token_id) AS rk
            FROM (SELECT h.sample_id, h.pos, c.token_id, c.logit, c.prob FROM g_hide{step.index} h JOIN g_cands c ON c.cond = h.cond AND c.pos = h.pos WHERE h.hide)) WHERE rk = 1""",
        )
        part(
            f"g_step{step.index}",
            f"""SELECT sample_id, pos, cond, CASE WHEN hide THEN pred ELSE token_id END AS token_id,
            CASE WHEN hide THEN round(1 - prob, 9) ELSE -1e5 END AS score FROM g_hide{step.index} LEFT JOIN g_pick{step.index} USING (sample_id, pos)""",
        )
    return f"SELECT sample_id, pos, token_id FROM g_step{timesteps - 1}"


part("g_guided", "SELECT cond, pos, token_id, u.logit + (c.logit - u.logit) * 3 AS logit FROM s_cond c JOIN s_null u USING (pos, token_id)")
part(
    "g_cands",
    f"""SELECT cond, pos, token_id, logit, exp(logit) / z AS prob FROM (SELECT *, sum(exp(logit)) OVER (PARTITION BY cond, pos) AS z,
    row_number() OVER (PARTITION BY cond, pos ORDER BY round(logit, 9) DESC, token_id) AS rk FROM g_guided) WHERE rk <= {KEPT}""",
)
part("g_start", f"SELECT sample_id, CAST(i AS INTEGER) AS pos, cond, {MASK} AS token_id, CAST(0 AS DOUBLE) AS score FROM e_cond, (SELECT unnest(range(16)) AS i)")


@query("generate", _canvas_sql(generating.TIMESTEPS, 41))
def _(spark, folder):
    flow = Flow(spark, folder)
    run = generating.Decoding(inputs.SIDE, inputs.CODES, seed=41, sampler="gumbel")
    return generating.generate(flow.conditions, flow.scorer, run)


def _inverse_sql(timesteps: int, seed: int, name: str = "i", side: int = inputs.SIDE, start: str = "g_start", cands: str = "g_cands") -> str:
    """Unrolled SQL of the decoding loop with one draw per position; its parts begin with ``name``."""
    for step in masking.schedule_steps(side**2, timesteps):
        i, before = step.index, f"{name}_step{step.index - 1}" if step.index else start
        part(
            f"{name}_hide{i}",
            f"""SELECT sample_id, pos, cond, token_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, pos) <= {step.hidden} AS hide,
            {U(seed, i, 'sample_id', 'pos')} AS u FROM {before}""",
        )
        heat = f"exp((logit - max(logit) OVER (PARTITION BY cond, pos)) / CAST({max(step.temperature, 1e-10)!r} AS DOUBLE))"
        part(f"{name}_heat{i}", f"SELECT *, {heat} AS w FROM {cands}")
        part(
            f"{name}_sums{i}",
            f"""SELECT cond, pos, token_id, prob, sum(w) OVER (PARTITION BY cond, pos ORDER BY token_id) AS upto, sum(w) OVER (PARTITION BY cond, pos) AS total FROM {name}_heat{i}""",
        )
        part(
            f"{name}_pick{i}",
            f"""SELECT sample_id, h.pos, min(c.token_id) AS pred, arg_min(prob, c.token_id) AS prob FROM {name}_hide{i} h
            JOIN {name}_sums{i} c ON c.cond = h.cond AND c.pos = h.pos WHERE h.hide AND c.upto > h.u * c.total GROUP BY 1, 2""",
        )
        part(
            f"{name}_step{i}",
            f"""SELECT sample_id, pos, cond, CASE WHEN hide THEN pred ELSE token_id END AS token_id,
            CASE WHEN hide THEN round(1 - prob, 9) ELSE -1e5 END AS score FROM {name}_hide{i} LEFT JOIN {name}_pick{i} USING (sample_id, pos)""",
        )
    return f"SELECT sample_id, pos, token_id FROM {name}_step{timesteps - 1}"


@query("generate_inverse", _inverse_sql(generating.TIMESTEPS, 41))
def _(spark, folder):
    flow = Flow(spark, folder)
    run = generating.Decoding(inputs.SIDE, inputs.CODES, seed=41, sampler="inverse")
    return generating.generate(flow.conditions, flow.scorer, run)


def _tokens_sql(name: str, pixels: str, side: int) -> None:
    """Parts that encode the 2 x 2 blocks of ``pixels`` by the nearest code; blocks without pixel get the lowest."""
    sums = ", ".join(f"sum(CASE WHEN (px % 2) * 2 + py % 2 = {i} THEN CAST(CAST(value AS FLOAT) AS DOUBLE) ELSE 0 END) AS v{i}" for i in range(4))
    part(f"{name}_blocks", f"SELECT gene_idx, CAST(px // 2 AS INTEGER) * {side} + CAST(py // 2 AS INTEGER) AS pos, {sums} FROM {pixels} GROUP BY 1, 2")
    part(
        f"{name}_best",
        f"""SELECT * FROM (SELECT gene_idx, pos, code_id, row_number() OVER (PARTITION BY gene_idx, pos
        ORDER BY round(list_cosine_similarity([v0, v1, v2, v3], cvec), 9) DESC, code_id) AS rn FROM {name}_blocks CROSS JOIN e_codebook) WHERE rn = 1""",
    )
    part(
        f"{name}_tokens",
        f"""SELECT sample_id, CAST(i AS INTEGER) AS pos, coalesce(code_id, (SELECT min(code_id) FROM e_codebook)) AS token_id
        FROM e_cond CROSS JOIN (SELECT unnest(range({side * side})) AS i) LEFT JOIN {name}_best b ON b.gene_idx = sample_id AND b.pos = i""",
    )


def _scorer_sql(name: str, seen: str) -> None:
    """Parts with the candidates of a scorer of weight 0.5 at the default guidance, null condition included."""
    part(f"{name}_seen", seen)
    part(f"{name}_prior", f"SELECT token_id, sum(n) / (SELECT sum(n) FROM {name}_seen) AS p FROM {name}_seen GROUP BY 1")
    part(f"{name}_null", f"SELECT pos, token_id, ln(n + 0.5 * p) AS logit FROM (SELECT pos, token_id, sum(n) AS n FROM {name}_seen GROUP BY 1, 2) JOIN {name}_prior USING (token_id)")
    part(
        f"{name}_guided",
        f"""SELECT c.cond, pos, token_id, u.logit + (ln(c.n + 0.5 * p) - u.logit) * 3 AS logit FROM {name}_seen c JOIN {name}_prior USING (token_id)
        JOIN {name}_null u USING (pos, token_id) UNION ALL SELECT -1, pos, token_id, logit FROM {name}_null""",
    )
    part(
        f"{name}_cands",
        f"""SELECT cond, pos, token_id, logit, exp(logit) / z AS prob FROM (SELECT *, sum(exp(logit)) OVER (PARTITION BY cond, pos) AS z,
        row_number() OVER (PARTITION BY cond, pos ORDER BY round(logit, 9) DESC, token_id) AS rk FROM {name}_guided) WHERE rk <= {KEPT}""",
    )


def _start_sql(name: str, conditions: str) -> None:
    """Part with a hidden canvas over ``conditions(sample_id, pos, cond)``; unknown ones become the null condition."""
    part(
        f"{name}_start",
        f"""SELECT sample_id, c.pos, CASE WHEN k.cond IS NULL THEN -1 ELSE c.cond END AS cond, {MASK} AS token_id, CAST(0 AS DOUBLE) AS score
        FROM ({conditions}) c LEFT JOIN (SELECT DISTINCT cond, pos FROM {name}_seen) k ON k.cond = c.cond AND k.pos = c.pos""",
    )


def _pixels_sql(tokens: str, side: int) -> str:
    """Pixels of decoded tokens, zeros absent."""
    return f"""SELECT gene_idx, CAST(pos // {side} * 2 + i // 2 AS INTEGER) AS px, CAST(pos % {side} * 2 + i % 2 AS INTEGER) AS py, v AS value FROM (
        SELECT CAST(sample_id AS BIGINT) AS gene_idx, pos, unnest(cvec) AS v, unnest(range(4)) AS i FROM ({tokens}) t JOIN e_codebook ON code_id = token_id) WHERE v <> 0"""


_CODES, _LOW = inputs.CODES, inputs.SIDE // 2
_UNDER = f"(i // {inputs.SIDE}) // 2 * {_LOW} + i % {inputs.SIDE} // 2"
_BY_POS = f"SELECT sample_id, CAST(i AS INTEGER) AS pos, cond * {_CODES} + token_id AS cond FROM (SELECT unnest(range({inputs.SIDE**2})) AS i) JOIN LOW l ON l.pos = {_UNDER} JOIN e_cond USING (sample_id)"
part("w_small", "SELECT gene_idx, px // 2 AS px, py // 2 AS py, value FROM e_pixels WHERE px % 2 = 0 AND py % 2 = 0")
_tokens_sql("w_low", "w_small", _LOW)
_scorer_sql("w_base", "SELECT cond, pos, token_id, count(*) AS n FROM w_low_tokens JOIN e_cond USING (sample_id) GROUP BY 1, 2, 3")
_start_sql("w_base", f"SELECT sample_id, CAST(i AS INTEGER) AS pos, cond FROM e_cond, (SELECT unnest(range({_LOW**2})) AS i)")
_tokens_sql("w_full", "e_pixels", inputs.SIDE)
_scorer_sql("w_super", f"SELECT c.cond, c.pos, t.token_id, count(*) AS n FROM w_full_tokens t JOIN ({_BY_POS.replace('LOW', 'w_low_tokens')}) c USING (sample_id, pos) GROUP BY 1, 2, 3")
part("w_image", _pixels_sql(_inverse_sql(generating.TIMESTEPS, 43, "w_one", _LOW, "w_base_start", "w_base_cands"), _LOW))
_tokens_sql("w_again", "w_image", _LOW)
_start_sql("w_super", _BY_POS.replace("LOW", "w_again_tokens"))
_TWO_STAGE = _pixels_sql(_inverse_sql(generating.TIMESTEPS, 44, "w_two", inputs.SIDE, "w_super_start", "w_super_cands"), inputs.SIDE)


@query("generate_two_stage", f"SELECT gene_idx, px, py, {R6('value')} AS value FROM ({_TWO_STAGE})")
def _(spark, folder):
    pixels = tables.embedding_pixels(spark, folder)
    book = inputs.codebook(spark, folder)
    fine = generating.Codec(book, inputs.CODES, inputs.SIZE, inputs.LAYERS)
    coarse = generating.Codec(book, inputs.CODES, inputs.SIZE // 2, inputs.LAYERS)
    samples = tables.embedding_conditions(spark, folder)
    low = cut_lineage(generating.lowres_tokens(pixels, inputs.SIZE, coarse))
    base = scoring.fit_token_scorer(low, samples, 0.5)
    by_pos = generating.lowres_conditions(samples, low, coarse.side, fine.side, coarse.codes)
    superres = scoring.fit_token_scorer(fine.encode(pixels), by_pos, 0.5)
    image = generating.generate_two_stage(samples, base, coarse, superres, fine, seed=43)
    return image.select("gene_idx", "px", "py", r6("value").alias("value"))
