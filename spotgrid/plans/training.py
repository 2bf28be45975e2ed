"""Fitting the codec and the token scorer, with validation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotgrid.functions.arrays import dot, l2_normalize
from spotgrid.operators.codebook import DECAY, assign_codes, commitment_loss, detokenize, tokenize
from spotgrid.operators.decoding import GUIDANCE
from spotgrid.operators.generating import Codec, lowres_conditions, lowres_tokens
from spotgrid.operators.losses import recon_loss
from spotgrid.operators.masking import condition_dropout, mask_tokens
from spotgrid.operators.mosaics import mosaic
from spotgrid.operators.raster import patch_vectors
from spotgrid.operators.sampling import SPLIT_SEED, VALID_FRAC, cycle_batches, exact_split, shuffle_batches
from spotgrid.operators.scoring import NULL_COND, TokenScorer, fit_token_scorer, resolve_conditions
from spotgrid.operators.tracking import accumulate_metrics
from spotgrid.operators.vector_sums import merge_partials, sum_vectors
from spotgrid.plans.session import cut_lineage
from spotgrid.sinks.snapshots import latest_step, load_snapshot, write_snapshot

METRICS = "step long, epoch int, key string, value double"


def refine_codebook(
    vectors: DataFrame,
    codebook: DataFrame,
    rounds: int,
    decay: float = DECAY,
    normalize: bool = False,
    snapshots: str | None = None,
    every: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Moving-average rounds: ``(codebook, metrics)`` with the commitment loss before each update.

    A round reads the vectors once: assignment and per-code sums run in the same
    tasks, and the loss follows from the sums (``sum |v|^2 - 2 c.sum v + n |c|^2``),
    whose squared lengths travel as one more element of the summed vector.  Per
    round ``k`` sums per task are shuffled, the state is materialised and one
    number reaches the driver.  With ``snapshots`` a later call resumes.
    """
    spark = vectors.sparkSession
    state = started(codebook)
    done = latest_step(spark, snapshots) if snapshots else None
    state = cut_lineage(state) if done is None else load_snapshot(spark, snapshots, done)
    metrics = []
    for step in range(0 if done is None else done + 1, rounds):
        state, gaps = codebook_step(state, vectors.select("vec"), decay, normalize)
        metrics.append((step, 1, "commitment", gaps["loss"]))
        if snapshots:
            write_snapshot(state, snapshots, step, every)
    return state.select("code_id", "vec"), spark.createDataFrame(metrics, METRICS)


def started(codebook: DataFrame) -> DataFrame:
    """State ``(code_id, n, total, vec)`` of a codebook before its first update."""
    return codebook.select("code_id", F.lit(1.0).alias("n"), F.col("vec").alias("total"), F.col("vec").alias("vec"))


def codebook_step(state: DataFrame, vectors: DataFrame, decay: float = DECAY, normalize: bool = False, by: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """One moving-average update: the materialised state, and ``loss``, the mean squared gap before it.

    The vectors are read once: assignment and sums run in the same tasks.  With ``by``,
    a column of ``vectors``, the loss is the mean over its values of their mean gaps,
    which are a handful of batches.
    """
    held: list = []
    extended = F.concat(F.transform("vec", lambda x: x.cast("double")), F.array(dot(F.col("vec"), F.col("vec"))))
    group = [] if by is None else [by]
    assigned = assign_codes(vectors.select(*group, "vec"), state.select("code_id", "vec"), held=held)
    if by is None:
        sums = sum_vectors(assigned.select("code_id", extended.alias("vec")), "code_id").withColumn("_by", F.lit(0).cast("long"))
    else:
        batches = [r[0] for r in vectors.select(by).distinct().orderBy(by).collect()] or [0]
        numbers = F.create_map(*[F.lit(x) for i, b in enumerate(batches) for x in (b, i)])
        key = (F.col("code_id").cast("long") * F.lit(len(batches)) + numbers[F.col(by)]).alias("_key")
        sums = sum_vectors(assigned.select(key, extended.alias("vec")), "_key")
        sums = sums.select(F.floor(F.col("_key") / len(batches)).cast("int").alias("code_id"), (F.col("_key") % len(batches)).alias("_by"), "n", "total")
    width = F.size("total") - 1
    fresh = cut_lineage(
        sums.select("code_id", "_by", F.col("n").alias("new_n"), F.slice("total", 1, width).alias("new"), F.get("total", width).alias("squares"), width.alias("dim"))
    )
    at = state.select("code_id", "vec").join(fresh, "code_id")
    gap = F.col("squares") - 2 * dot(F.col("vec"), F.col("new")) + F.col("new_n") * dot(F.col("vec"), F.col("vec"))
    means = at.groupBy("_by").agg((F.sum(gap) / F.sum(F.col("new_n") * F.col("dim"))).alias("mean"))
    loss = means.agg(F.avg("mean")).first()[0]
    whole = fresh if by is None else sum_counted(fresh)
    keep, add = F.lit(float(decay)), F.lit(1.0 - decay)
    joined = state.join(whole.select("code_id", "new_n", "new"), "code_id", "left")
    n = keep * F.col("n") + add * F.coalesce("new_n", F.lit(0))
    blended = F.zip_with("total", "new", lambda old, new: keep * old + add * new)
    total = F.coalesce(blended, F.transform("total", lambda old: keep * old))
    vec = F.transform("total", lambda x: x / F.greatest("n", F.lit(1e-12)))
    updated = joined.select("code_id", n.alias("n"), total.alias("total"))
    updated = cut_lineage(updated.withColumn("vec", l2_normalize(vec) if normalize else vec))
    for broadcast in held:
        broadcast.destroy()
    return updated, {"loss": loss}


def sum_counted(fresh: DataFrame) -> DataFrame:
    """``(code_id, new_n, new)`` of rows per code and batch added up per code."""
    parts = fresh.select("code_id", F.col("new_n").alias("n"), F.col("new").alias("total"))
    return merge_partials(parts, "code_id").select("code_id", F.col("n").alias("new_n"), F.col("total").alias("new"))


def train_codec(
    pixels: DataFrame,
    genes: DataFrame,
    codebook: DataFrame,
    image_size: int,
    layers: int,
    steps: int,
    batch_size: int,
    results: str,
    grad_accum: int = 1,
    valid_frac: float = VALID_FRAC,
    seed: int = SPLIT_SEED,
    decay: float = DECAY,
    every: int = 1000,
    keep: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Moving-average training of a codec by batches of images, with a hold-out and results.

    ``genes(gene_idx)`` are split exactly; a step assigns the blocks of ``grad_accum``
    batches of training images and updates the codes once.  Every ``every`` steps, and
    after the last one, the state is saved below ``results/codec`` (the last ``keep`` stay),
    the hold-out is rated, and the next batch of hold-out images is laid out beside its
    reconstructions below ``results/mosaic``.  A later call goes on after the last step
    saved.  Returns the codebook and ``metrics(step, epoch, key, value)``: ``loss`` of
    each step, the mean over its batches; ``valid`` and ``valid_l1``, gap of the blocks and
    of the images of the hold-out, when rated.
    """
    spark = pixels.sparkSession
    split = cut_lineage(exact_split(genes.select("gene_idx").distinct(), "gene_idx", valid_frac, seed))
    train, valid = (split.where(F.col("split") == name).drop("split") for name in ("train", "valid"))
    plan = cut_lineage(cycle_batches(train, "gene_idx", batch_size, steps, grad_accum, seed))
    blocks = cut_lineage(patch_vectors(pixels, image_size, layers))
    n_valid = valid.count()
    shown = cut_lineage(shuffle_batches(valid, "gene_idx", batch_size, 0, seed))
    held_pixels, held_blocks = pixels.join(valid, "gene_idx", "left_semi"), blocks.join(valid, "gene_idx", "left_semi")
    saved = f"{results.rstrip('/')}/codec"
    done = latest_step(spark, saved)
    state = cut_lineage(started(codebook)) if done is None else load_snapshot(spark, saved, done)
    metrics, rated = [], 0
    per_epoch = max(1, -(-train.count() // batch_size))
    for step in range(0 if done is None else done + 1, steps):
        now = plan.where(F.col("step") == step).select("gene_idx", (F.col("epoch").cast("long") * per_epoch + F.col("batch_id")).alias("batch"))
        epoch = (step * grad_accum) // per_epoch + 1
        state, found = codebook_step(state, blocks.join(now, "gene_idx").select("batch", "vec"), decay, by="batch")
        metrics.append((step, epoch, "loss", found["loss"]))
        if step % every and step + 1 < steps:
            continue
        write_snapshot(state, saved, step, 1, keep)
        state = load_snapshot(spark, saved, step)
        if not n_valid:
            continue
        codes = state.select("code_id", "vec")
        gap = commitment_loss(assign_codes(held_blocks, codes), codes).first()[0]
        recon = detokenize(tokenize(held_pixels, codes, image_size, layers, valid.select(F.col("gene_idx").alias("sample_id"))), codes, image_size, layers)
        l1 = recon_loss(held_pixels, recon, n_valid * image_size * image_size).first()[0]
        metrics += [(step, epoch, "valid", gap), (step, epoch, "valid_l1", l1)]
        batch = shown.where(F.col("batch_id") == rated % max(1, -(-n_valid // batch_size))).select("gene_idx")
        picture = mosaic(held_pixels.join(batch, "gene_idx", "left_semi"), recon.join(batch, "gene_idx", "left_semi"), image_size, genes=batch)
        write_snapshot(picture, f"{results.rstrip('/')}/mosaic", step, 1, keep)
        rated += 1
    return state.select("code_id", "vec"), spark.createDataFrame(metrics, METRICS)


def train_scorer(
    tokens: DataFrame,
    conditions: DataFrame,
    mask_id: int,
    alpha: float = 1.0,
    valid_frac: float = VALID_FRAC,
    seed: int = SPLIT_SEED,
    scale: float = GUIDANCE,
) -> tuple[TokenScorer, DataFrame]:
    """Fit on the training samples and rate on the hold-out: ``(scorer, one-row loss)``.

    ``conditions(sample_id, cond)`` lists the samples.  The loss is the cross
    entropy of hidden hold-out positions over the ``mask_id`` tokens of the
    vocabulary; it is finite, since unseen tokens have mass too.
    """
    split = cut_lineage(exact_split(conditions, "sample_id", valid_frac, seed))
    train = split.where("split = 'train'").drop("split")
    valid = split.where("split = 'valid'").drop("split")
    scorer = fit_token_scorer(tokens, train, alpha, mask_id).saved()
    hidden = mask_tokens(tokens.join(valid.select("sample_id"), "sample_id", "left_semi"), mask_id, seed)
    labels = resolve_conditions(hidden.join(valid, "sample_id"), scorer)
    return scorer, scorer.cross_entropy(labels, mask_id, scale)


def flow_steps(conditions: DataFrame, batch_size: int, passes: float, valid_frac: float = VALID_FRAC) -> int:
    """Steps of :func:`train_flow` that make ``passes`` passes over the training samples, the last one rounded up."""
    train = conditions.count() if valid_frac == 0 else int((1.0 - valid_frac) * conditions.count())
    return max(1, math.ceil(passes * -(-train // batch_size)))


def train_flow(
    tokens: DataFrame,
    conditions: DataFrame,
    mask_id: int,
    steps: int,
    batch_size: int,
    snapshots: str,
    alpha: float = 1.0,
    valid_frac: float = VALID_FRAC,
    seed: int = SPLIT_SEED,
    scale: float = GUIDANCE,
    dropout: float = 0.0,
    no_mask_prob: float = 0.0,
    grad_accum: int = 1,
    log_steps: bool = False,
    positions: DataFrame | None = None,
) -> tuple[TokenScorer, DataFrame]:
    """Fit the scorer batch by batch, with validation and a snapshot as every epoch closes.

    ``steps`` times ``grad_accum`` batches are drawn pass after pass from the training
    samples of ``conditions(sample_id, cond)``.  In every pass a sample loses its condition with
    probability ``dropout`` and then counts for the null condition alone.  Counts
    of a pass are added to those before it and saved under ``snapshots``; a later
    call goes on after the last pass saved there.  Returns the scorer after the last
    step and ``metrics(step, epoch, key, value)``: the hold-out loss of each epoch
    that closed in this call, counted from 1; with ``log_steps`` also ``train``, the loss
    of each step's batches under the counts of the passes before, from the second pass
    on, every batch with a share of one in ``grad_accum``.  ``positions(sample_id, pos,
    cond)`` gives every position a condition of its own in place of its sample's.
    """
    spark = tokens.sparkSession
    split = cut_lineage(exact_split(conditions, "sample_id", valid_frac, seed))
    train = split.where("split = 'train'").drop("split")
    valid = split.where("split = 'valid'").drop("split")
    per_epoch = max(1, -(-train.count() // batch_size))
    batches = steps * grad_accum
    plan = cut_lineage(cycle_batches(train, "sample_id", batch_size, steps, grad_accum, seed).select("step", "epoch", "batch_id", "sample_id", "cond"))
    held = tokens.join(valid.select("sample_id"), "sample_id", "left_semi")
    hidden = mask_tokens(held, mask_id, seed, no_mask_prob=no_mask_prob).where("masked")
    hidden = cut_lineage(hidden.join(valid, "sample_id") if positions is None else hidden.join(positions, ["sample_id", "pos"]))
    done = latest_step(spark, snapshots)
    seen = load_snapshot(spark, snapshots, done) if done is not None else None
    metrics = []
    for epoch in range(0 if done is None else done + 1, -(-batches // per_epoch)):
        now = plan.where(F.col("epoch") == epoch)
        if log_steps and seen is not None:
            shown = mask_tokens(tokens.join(now.select("sample_id"), "sample_id", "left_semi"), mask_id, seed + epoch, no_mask_prob=no_mask_prob).where("masked")
            shown = shown.join(now, "sample_id") if positions is None else shown.join(now.drop("cond"), "sample_id").join(positions, ["sample_id", "pos"])
            metrics += _step_losses(TokenScorer(seen, alpha, mask_id), shown, mask_id, scale, grad_accum, epoch)
        told = condition_dropout(now.select("epoch", "sample_id", "cond").withColumn("usable", F.lit(True)), dropout, seed + epoch)
        if positions is not None:
            told = told.select("sample_id", "usable").join(positions, "sample_id")
        cond = F.when(F.col("usable"), F.col("cond").cast("long")).otherwise(F.lit(NULL_COND).cast("long"))
        fresh = fit_token_scorer(tokens, told.select("sample_id", *(["pos"] if positions is not None else []), cond.alias("cond")), alpha).seen
        both = fresh if seen is None else seen.unionByName(fresh).groupBy("cond", "pos", "token_id").agg(F.sum("n").alias("n"))
        last = min(batches, (epoch + 1) * per_epoch) - 1
        if last + 1 < (epoch + 1) * per_epoch:  # the steps end inside this pass
            seen = cut_lineage(both)
            break
        write_snapshot(both, snapshots, epoch)
        seen = load_snapshot(spark, snapshots, epoch)
        scorer = TokenScorer(seen, alpha, mask_id)
        loss = scorer.cross_entropy(resolve_conditions(hidden, scorer), mask_id, scale).first()[0]
        metrics.append((last // grad_accum, epoch + 1, "valid", loss))
    if seen is None:
        raise ValueError("no steps to train")
    return TokenScorer(seen, alpha, mask_id), spark.createDataFrame(metrics, METRICS)


def _step_losses(scorer: TokenScorer, labels: DataFrame, vocab: int, scale: float, grad_accum: int, epoch: int) -> list[tuple]:
    """Accumulated training loss per step of one pass; a number per step reaches the driver."""
    per_batch = scorer.cross_entropy(resolve_conditions(labels, scorer), vocab, scale, by=("step", "batch_id"))
    logged = accumulate_metrics(per_batch.select("step", F.lit("train").alias("key"), F.col("loss").alias("value")), grad_accum)
    return [(r["step"], epoch + 1, r["key"], r["value"]) for r in logged.orderBy("step").collect()]


def train_two_stage(
    pixels: DataFrame,
    conditions: DataFrame,
    in_size: int,
    base_codec: Codec,
    superres_codec: Codec,
    steps: int,
    batch_size: int,
    results: str,
    superres_steps: int | None = None,
    **settings,
) -> tuple[TokenScorer, TokenScorer, DataFrame]:
    """Train the scorers of both resolutions on images of ``in_size``: ``(base, superres, metrics)``.

    The base stage learns the tokens of the resized images under the samples'
    conditions.  The second stage learns the tokens of its own resolution, every
    position under its sample's condition and the low-resolution token at its place,
    which is what :func:`spotgrid.operators.generating.generate_two_stage` asks it for.
    Both are :func:`train_flow` with its ``settings``, with snapshots below
    ``results/base`` and ``results/superres``; ``metrics`` has the stage before each key.
    """
    low = cut_lineage(lowres_tokens(pixels, in_size, base_codec, conditions))
    base, first = train_flow(low, conditions, base_codec.codes, steps, batch_size, f"{results.rstrip('/')}/base", **settings)
    high = cut_lineage(lowres_tokens(pixels, in_size, superres_codec, conditions))
    positions = cut_lineage(lowres_conditions(conditions, low, base_codec.side, superres_codec.side, base_codec.codes))
    superres, second = train_flow(
        high, conditions, superres_codec.codes, superres_steps or steps, batch_size, f"{results.rstrip('/')}/superres", positions=positions, **settings
    )
    named = lambda metrics, stage: metrics.withColumn("key", F.concat(F.lit(f"{stage}/"), F.col("key")))
    return base, superres, named(first, "base").unionByName(named(second, "superres"))
