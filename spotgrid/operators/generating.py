"""Iterative masked generation in one or two resolutions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotgrid.functions.arrays import let
from spotgrid.functions.keyed import uniform
from spotgrid.functions.scalars import grid_side
from spotgrid.operators.codebook import detokenize, tokenize
from spotgrid.operators.decoding import (
    GUIDANCE,
    TEMPERATURE_FLOOR,
    TOPK_THRES,
    critic_scores,
    kept_logits,
    log_normalizer,
    noisy_logit,
    predict,
    topk_filter,
)
from spotgrid.operators.masking import (
    SETTLED_SCORE,
    TIMESTEPS,
    Step,
    init_canvas,
    remask_topk,
    schedule_steps,
)
from spotgrid.operators.raster import resize_nearest
from spotgrid.operators.scoring import NULL_COND, ScoreFunction, TokenScorer, resolve_conditions, score_function
from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import fits
from spotgrid.sinks.snapshots import latest_step, load_snapshot, write_snapshot

# Bytes of one (token, logit, probability) candidate in a row.
CANDIDATE_BYTES = 40

# Scores are compared at this many digits, so that equal probabilities tie (and the
# lower position wins) whatever the order of summation was.
SCORE_DIGITS = 9

# A floor for logits missing on one side of a negative condition.
MISSING_LOGIT = -20.0

# Settled positions are spread over this many keys that match no candidate.
UNMATCHED_KEYS = 1 << 20

Critic = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Decoding:
    """Settings of one generation run.

    ``sampler='gumbel'`` adds keyed noise to every candidate; ``'inverse'`` draws
    from the same distribution with one number per position and needs a scorer
    table.  By default a scorer table is drawn from by ``'inverse'`` and anything
    else by ``'gumbel'``.
    """

    side: int
    vocab: int
    seed: int
    timesteps: int = TIMESTEPS
    cond_scale: float = GUIDANCE
    temperature: float = 1.0
    thres: float = TOPK_THRES
    can_remask: bool = False
    no_mask_prob: float = 0.0
    critic_noise: float = 1.0
    cut_every: int = 6
    sampler: str | None = None

    @property
    def mask_id(self) -> int:
        return self.vocab

    def resolved(self, by_table: bool, critic: Critic | None) -> Decoding:
        """The settings with a sampler chosen, or an error if they do not fit together."""
        sampler = self.sampler or ("inverse" if by_table else "gumbel")
        if sampler not in ("gumbel", "inverse"):
            raise ValueError(f"unknown sampler {sampler!r}")
        if sampler == "inverse" and not by_table:
            raise ValueError("the inverse sampler needs a token scorer without critic")
        if self.can_remask and critic is None and self.no_mask_prob <= 0:
            raise ValueError("revising settled positions needs a scorer fitted with no_mask_prob > 0")
        return replace(self, sampler=sampler)


def _kept_with_prob(logits: DataFrame, vocab: int, thres: float, keys: tuple[str, ...]) -> DataFrame:
    """Filtered logits with their unfiltered softmax ``prob``; all parts share one shuffle on the keys."""
    logz = log_normalizer(logits, keys)
    kept = topk_filter(logits, vocab, thres, keys).join(logz, list(keys))
    return kept.select(*keys, "token_id", "logit", F.exp(F.col("logit") - F.col("logz")).alias("prob"))


def candidate_table(logits: DataFrame, vocab: int, thres: float, keys: tuple[str, ...]) -> DataFrame:
    """Candidates per distribution: ``(*keys, candidates)``.

    Scores depend on condition and position only, so filter and softmax are done
    once per key and not once per sample and step.  A candidate list has at most
    ``kept_logits(vocab, thres)`` entries.
    """
    entry = F.struct("token_id", "logit", "prob")
    kept = _kept_with_prob(logits, vocab, thres, keys)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("candidates"))


def draw_table(logits: DataFrame, vocab: int, thres: float, keys: tuple[str, ...], steps: list[Step]) -> DataFrame:
    """Candidates with the upper edges of their share at each step's temperature.

    ``(*keys, tokens, probs, edges_0, edges_1, ...)``: a uniform draw ``u`` picks
    the first candidate whose edge exceeds ``u``.  The running sums are windows
    over the shared distributions, so a position only searches.
    """
    kept = _kept_with_prob(logits, vocab, thres, keys)
    whole = Window.partitionBy(*keys)
    peaked = kept.withColumn("_peak", F.max("logit").over(whole))
    heat = lambda step: F.lit(1.0 / max(step.temperature, TEMPERATURE_FLOOR))
    weights = {f"_w{step.index}": F.exp((F.col("logit") - F.col("_peak")) * heat(step)) for step in steps}
    upto = whole.orderBy("token_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"_u{step.index}": F.sum(f"_w{step.index}").over(upto) for step in steps}
    entry = F.struct("token_id", "prob", *sums)
    packed = peaked.withColumns(weights).withColumns(sums).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("e"))

    def edges(step: Step) -> Column:
        running = F.col(f"e._u{step.index}")
        return F.transform(running, lambda x: x / F.element_at(running, -1)).alias(f"edges_{step.index}")

    return packed.select(*keys, F.col("e.token_id").alias("tokens"), F.col("e.prob").alias("probs"), *map(edges, steps))


def _gumbel_pick(step: Step, run: Decoding) -> Column:
    """Candidate with the highest noisy logit: ``struct(token, prob)``."""

    def entry(c: Column) -> Column:
        keys = (step.index, F.col("sample_id"), F.col("pos"), c["token_id"])
        value = noisy_logit(c["logit"], step.temperature, run.seed, *keys)
        return F.struct(value.alias("v"), (-c["token_id"]).alias("t"), c["prob"].alias("prob"))

    best = F.array_max(F.transform("candidates", entry))
    return let(best, lambda b: F.struct((-b["t"]).alias("token"), b["prob"].alias("prob")))


def _inverse_pick(step: Step, run: Decoding) -> Column:
    """Candidate whose share holds one uniform draw: ``struct(token, prob)``.

    A binary search over the running sums: strides of falling powers of two, each
    taken if the edge it reaches does not exceed the draw.
    """
    draw = uniform(run.seed, step.index, "sample_id", "pos")
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(kept_logits(run.vocab, run.thres).bit_length()))])
    edge = lambda at: F.get(f"edges_{step.index}", at)
    below = lambda u: F.aggregate(strides, F.lit(0), lambda n, s: n + F.when(edge(n + s - 1) <= u, s).otherwise(0))
    pick = lambda at: F.struct(F.get("tokens", at).alias("token"), F.get("probs", at).alias("prob"))
    return let(let(draw, below), pick)


def _table_step(
    canvas: DataFrame, candidates: DataFrame, keys: list[str], step: Step, run: Decoding, small: bool = True
) -> DataFrame:
    """One step against a candidate table: a window per sample and one join, nothing exploded."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), F.asc("pos"))
    ranked = canvas.withColumn("_hide", F.row_number().over(order) <= step.hidden)
    # Positions that stay settled need no candidates: they look for a position below
    # zero, which none has, and their keys are spread over the samples.
    nowhere = F.lit(-1) - F.pmod(F.xxhash64("sample_id", "pos"), F.lit(UNMATCHED_KEYS)).cast("int")
    ranked = ranked.withColumn("_pos", F.col("pos") if run.can_remask else F.when(F.col("_hide"), F.col("pos")).otherwise(nowhere))
    used = ["candidates"] if run.sampler == "gumbel" else ["tokens", "probs", f"edges_{step.index}"]
    side = candidates.withColumnRenamed("pos", "_pos").select(*["_pos" if k == "pos" else k for k in keys], *used)
    if small:
        side = F.broadcast(side)
    joined = ranked.join(side, ["_pos" if k == "pos" else k for k in keys], "left")

    pick = _gumbel_pick(step, run) if run.sampler == "gumbel" else _inverse_pick(step, run)
    # A position that stays settled is not drawn again.
    picked = joined.withColumn("_best", pick if run.can_remask else F.when(F.col("_hide"), pick))
    token = F.when(F.col("_hide"), F.coalesce("_best.token", F.lit(run.mask_id))).otherwise(F.col("token_id"))
    score = F.round(F.lit(1.0) - F.coalesce("_best.prob", F.lit(0.0)), SCORE_DIGITS)
    if not run.can_remask:
        score = F.when(F.col("_hide"), score).otherwise(F.lit(SETTLED_SCORE))
    return picked.select("sample_id", "pos", *[k for k in keys if k != "pos"], token.alias("token_id"), score.alias("score"))


def _general_step(canvas: DataFrame, scorer: ScoreFunction, critic: Critic | None, step: Step, run: Decoding) -> DataFrame:
    """One step with a pluggable scorer (and critic) over long logits."""
    hidden = remask_topk(canvas, step.hidden, run.mask_id).withColumn("was_masked", F.col("token_id") == run.mask_id)
    asked = hidden if run.can_remask else hidden.where("was_masked")
    pred = predict(scorer(asked), run.vocab, run.thres, step.temperature, run.seed, (step.index,))
    joined = hidden.join(pred, ["sample_id", "pos"], "left")
    token = F.when(F.col("was_masked"), F.coalesce("pred_id", F.col("token_id"))).otherwise(F.col("token_id"))
    score = F.round(F.lit(1.0) - F.coalesce("prob", F.lit(0.0)), SCORE_DIGITS)
    if not run.can_remask:
        score = F.when(F.col("was_masked"), score).otherwise(F.lit(SETTLED_SCORE))
    extra = [c for c in canvas.columns if c not in ("sample_id", "pos", "token_id", "score")]
    filled = joined.select("sample_id", "pos", *extra, token.alias("token_id"), score.alias("score"))
    if critic is None:
        return filled
    filled = cut_lineage(filled.drop("score"))
    judged = critic(filled.select("sample_id", "pos", "token_id"))
    scores = critic_scores(judged, step.index, run.timesteps, run.seed, run.critic_noise)
    return filled.join(scores, ["sample_id", "pos"])


def generate(
    samples: DataFrame,
    scorer: TokenScorer | ScoreFunction,
    run: Decoding,
    critic: Critic | None = None,
    snapshots: str | None = None,
) -> DataFrame:
    """Fill a hidden canvas over ``run.timesteps`` steps: ``tokens(sample_id, pos, token_id)``.

    ``samples(sample_id, cond)`` or, with a condition per position,
    ``(sample_id, pos, cond)``; an optional ``neg_cond`` is guided away from.  The
    driver holds the step counter only.  With a :class:`TokenScorer` a step is one
    window per sample and one join; a broadcast candidate table keeps the canvas
    partitioned by sample throughout, so the steps between two cuts form a single
    stage.  The lineage is cut every ``run.cut_every`` steps, either by a
    checkpoint or, with ``snapshots``, by tables a later run resumes from.  Positions
    that have settled by then leave the canvas and join the result at the end, so
    that later steps have fewer rows.
    """
    by_table = isinstance(scorer, TokenScorer) and critic is None
    run = run.resolved(by_table, critic)
    spark = samples.sparkSession
    # The canvas is small in bytes and costly per row, so its partitions are not left to size-based coalescing.
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = schedule_steps(run.side * run.side, run.timesteps, run.temperature)
    if isinstance(scorer, TokenScorer) and "cond" not in samples.columns:
        samples = samples.withColumn("cond", F.lit(NULL_COND))
    extra = [c for c in ("cond", "neg_cond") if c in samples.columns]
    if "pos" in samples.columns:
        canvas = samples.select("sample_id", "pos", F.lit(run.mask_id).alias("token_id"), F.lit(0.0).alias("score"), *extra)
    else:
        blank = init_canvas(samples, run.side, run.mask_id)
        canvas = blank.join(samples.select("sample_id", *extra), "sample_id") if extra else blank

    if isinstance(scorer, TokenScorer):
        scorer = scorer.saved()
        for column in extra:
            canvas = resolve_conditions(canvas, scorer, column)
    if by_table:
        keys = [*extra, "pos"]
        if "neg_cond" in extra:
            pairs = canvas.select("cond", "neg_cond").distinct()
            logits = scorer.away_from(pairs, run.cond_scale, MISSING_LOGIT)
        else:
            logits = scorer.guided(run.cond_scale)
        if run.sampler == "gumbel":
            candidates = candidate_table(logits, run.vocab, run.thres, tuple(keys))
        else:
            candidates = draw_table(logits, run.vocab, run.thres, tuple(keys), steps)
        candidates = cut_lineage(candidates)
        small = fits(candidates.count(), 64 + CANDIDATE_BYTES * kept_logits(run.vocab, run.thres))
    elif isinstance(scorer, TokenScorer):
        scorer = score_function(scorer, run.cond_scale, MISSING_LOGIT)

    done = latest_step(spark, snapshots) if snapshots else None
    if done is None:
        canvas = cut_lineage(canvas)
    else:
        canvas = load_snapshot(spark, snapshots, done)
        steps = steps[done + 1 :]

    settled: list[DataFrame] = []

    def parted(canvas: DataFrame) -> DataFrame:
        """The open positions of a materialised canvas; settled ones are put aside for good."""
        if run.can_remask or not by_table:
            return canvas.repartition(spread, "sample_id")
        done = F.col("score") == F.lit(SETTLED_SCORE)
        settled.append(canvas.where(done).select("sample_id", "pos", "token_id"))
        return canvas.where(~done).repartition(spread, "sample_id")

    canvas = parted(canvas) if done is not None else canvas.repartition(spread, "sample_id")
    for step in steps:
        if by_table:
            canvas = _table_step(canvas, candidates, keys, step, run, small)
        else:
            canvas = _general_step(canvas, scorer, critic, step, run)
        last = step.left == 0
        if snapshots and (last or (step.index + 1) % run.cut_every == 0):
            aside = [s.withColumns({c: F.lit(None).cast(canvas.schema[c].dataType) for c in canvas.columns if c not in s.columns} | {"score": F.lit(SETTLED_SCORE)}) for s in settled]
            whole = reduce(DataFrame.unionByName, aside, canvas)
            write_snapshot(whole, snapshots, step.index)
            settled.clear()
            canvas = parted(load_snapshot(spark, snapshots, step.index))
        elif not last and (step.index + 1) % (run.cut_every if by_table else 1) == 0:
            canvas = parted(cut_lineage(canvas))
    return reduce(DataFrame.unionByName, settled, canvas.select("sample_id", "pos", "token_id"))


@dataclass(frozen=True)
class Codec:
    """A codebook with the geometry of the images it encodes."""

    codebook: DataFrame
    codes: int
    image_size: int
    layers: int

    @property
    def side(self) -> int:
        return grid_side(self.image_size, self.layers)

    def encode(self, pixels: DataFrame, samples: DataFrame | None = None) -> DataFrame:
        return tokenize(pixels, self.codebook, self.image_size, self.layers, samples)

    def decode(self, tokens: DataFrame) -> DataFrame:
        return detokenize(tokens, self.codebook, self.image_size, self.layers, self.codes)


def lowres_tokens(pixels: DataFrame, in_size: int, codec: Codec, samples: DataFrame | None = None) -> DataFrame:
    """Resize images to the codec's size and encode them; of every sample, if given."""
    return codec.encode(resize_nearest(pixels, in_size, codec.image_size), samples)


def lowres_conditions(samples: DataFrame, low: DataFrame, low_side: int, side: int, codes: int) -> DataFrame:
    """``(sample_id, pos, cond)``: sample condition and the low-resolution token under each position."""
    at = low.select(
        F.col("sample_id").alias("gene_idx"),
        F.floor(F.col("pos") / F.lit(low_side)).cast("int").alias("px"),
        (F.col("pos") % F.lit(low_side)).cast("int").alias("py"),
        F.col("token_id").alias("value"),
    )
    spread = resize_nearest(at, low_side, side).select(
        F.col("gene_idx").alias("sample_id"), (F.col("px") * side + F.col("py")).alias("pos"), F.col("value").alias("low")
    )
    cond = F.col("cond").cast("long") * F.lit(codes) + F.col("low")
    return spread.join(samples.select("sample_id", "cond"), "sample_id").select("sample_id", "pos", cond.alias("cond"))


def generate_two_stage(
    samples: DataFrame,
    base: TokenScorer,
    base_codec: Codec,
    superres: TokenScorer,
    superres_codec: Codec,
    seed: int,
    timesteps: int = TIMESTEPS,
    superres_timesteps: int | None = None,
    cond_codec: Codec | None = None,
    return_lowres: bool = False,
    **settings,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Generate at low resolution, then again with the result as condition; returns pixels."""
    cond_codec = cond_codec or base_codec
    first = Decoding(base_codec.side, base_codec.codes, seed, timesteps, **settings)
    low_image = cut_lineage(base_codec.decode(generate(samples, base, first)))
    # A sample whose low-resolution image is blank has no pixels; it keeps the blank token everywhere.
    low = lowres_tokens(low_image, base_codec.image_size, cond_codec, samples)
    conditions = lowres_conditions(samples, low, cond_codec.side, superres_codec.side, cond_codec.codes)
    second = Decoding(superres_codec.side, superres_codec.codes, seed + 1, superres_timesteps or timesteps, **settings)
    image = superres_codec.decode(generate(conditions, superres, second))
    return (image, low_image) if return_lowres else image
