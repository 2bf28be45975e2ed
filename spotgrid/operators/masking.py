"""Hiding and revealing tokens.

Tables are keyed by ``(sample_id, pos)`` with ``0 <= pos < seq_len``, so a window
over one sample holds at most ``seq_len`` rows (checked by ``validate_dataset``);
no window here grows with the number of samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotgrid.functions.keyed import prob_mask, uniform
from spotgrid.functions.scalars import cosine_schedule, where_masked

# Label of positions outside the loss, decoding steps, score of settled positions.
IGNORE_INDEX = -1
TIMESTEPS = 18
SETTLED_SCORE = -1e5


def mask_tokens(
    tokens: DataFrame,
    mask_id: int,
    seed: int,
    ignore_index: int = IGNORE_INDEX,
    no_mask_prob: float = 0.0,
    schedule=cosine_schedule,
) -> DataFrame:
    """Hide a random share of every sample by the schedule.

    Returns ``(sample_id, pos, token_id, masked, label, x)``.  Exactly
    ``max(1, half_even(schedule(t) * len))`` positions get a label; with
    ``no_mask_prob`` part of those still show their true token in ``x``.
    """
    sample = Window.partitionBy("sample_id")
    time = uniform(seed, "sample_id")
    drawn = tokens.withColumn("_draw", uniform(seed, "sample_id", "pos"))
    # Ranking first lets the count reuse its sort.
    ranked = drawn.withColumn("_rank", F.row_number().over(sample.orderBy("_draw", "pos")) - 1)
    ranked = ranked.withColumn("_len", F.count(F.lit(1)).over(sample))
    hidden = F.greatest(F.bround(schedule(time) * F.col("_len")), F.lit(1.0))
    masked = ranked.withColumn("masked", F.col("_rank") < hidden)
    out = masked.select(
        "sample_id",
        "pos",
        "token_id",
        "masked",
        where_masked(F.col("masked"), F.col("token_id"), F.lit(ignore_index)).alias("label"),
        where_masked(F.col("masked"), F.lit(mask_id), F.col("token_id")).alias("x"),
    )
    if no_mask_prob > 0:
        return mask_subset(out, no_mask_prob, seed + 1)
    return out


def mask_subset(masked: DataFrame, prob: float, seed: int, min_mask: int = 0) -> DataFrame:
    """Let part of the hidden positions show their true token in ``x``.

    Of the m hidden positions of a sample, those with random rank below
    ``max(prob * m, min_mask)`` are shown; labels stay.
    """
    inside = Window.partitionBy("sample_id", "masked")
    drawn = masked.withColumn("_draw", uniform(seed, "sample_id", "pos"))
    ranked = drawn.withColumn("_rank", F.row_number().over(inside.orderBy("_draw", "pos")) - 1)
    ranked = ranked.withColumn("_m", F.count(F.lit(1)).over(inside))
    shown = F.col("masked") & (F.col("_rank") < F.greatest(F.col("_m") * F.lit(float(prob)), F.lit(float(min_mask))))
    return ranked.select(
        *[c for c in masked.columns if c != "x"], where_masked(shown, F.col("token_id"), F.col("x")).alias("x")
    )


def init_canvas(samples: DataFrame, side: int, mask_id: int) -> DataFrame:
    """``canvas(sample_id, pos, token_id, score)``: everything hidden, score zero."""
    positions = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    return samples.select("sample_id", positions.alias("pos"), F.lit(mask_id).alias("token_id"), F.lit(0.0).alias("score"))


@dataclass(frozen=True)
class Step:
    """One decoding step: how many positions to hide and how hot to sample."""

    index: int
    left: int
    hidden: int
    temperature: float


def schedule_steps(seq_len: int, timesteps: int = TIMESTEPS, temperature: float = 1.0) -> list[Step]:
    """Driver-side schedule of :func:`decode_schedule` for one length."""
    steps = []
    for i in range(timesteps):
        t = i / (timesteps - 1) if timesteps > 1 else 0.0
        left = timesteps - 1 - i
        hidden = max(int(math.cos(t * math.pi * 0.5) * seq_len), 1)
        steps.append(Step(i, left, hidden, temperature * left / timesteps))
    return steps


def decode_schedule(lengths: DataFrame, timesteps: int = TIMESTEPS, temperature: float = 1.0) -> DataFrame:
    """Add ``step, t, steps_left, hidden, temp`` for every row's ``seq_len``."""
    rows = lengths.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(timesteps - 1))))
    t = F.col("step") / F.lit(float(max(timesteps - 1, 1)))
    left = F.lit(timesteps - 1) - F.col("step")
    hidden = F.greatest((cosine_schedule(t) * F.col("seq_len")).cast("long"), F.lit(1).cast("long"))
    return rows.select(
        *lengths.columns,
        "step",
        t.alias("t"),
        left.alias("steps_left"),
        hidden.alias("hidden"),
        (F.lit(float(temperature)) * left / F.lit(timesteps)).alias("temp"),
    )


def remask_topk(canvas: DataFrame, k: int | Column, mask_id: int) -> DataFrame:
    """Hide the ``k`` highest scores of every sample; ties go to the lower position."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), F.asc("pos"))
    ranked = canvas.withColumn("_rank", F.row_number().over(order))
    token = where_masked(F.col("_rank") <= k, F.lit(mask_id), F.col("token_id"))
    return ranked.select(*[token.alias(c) if c == "token_id" else F.col(c) for c in canvas.columns])


def fill_masked(canvas: DataFrame, pred: DataFrame, mask_id: int) -> DataFrame:
    """Put predictions ``(sample_id, pos, pred_id)`` on hidden positions only."""
    joined = canvas.join(pred.select("sample_id", "pos", "pred_id"), ["sample_id", "pos"], "left")
    hidden = (F.col("token_id") == mask_id) & F.col("pred_id").isNotNull()
    token = where_masked(hidden, F.col("pred_id"), F.col("token_id"))
    return joined.select(*[token.alias(c) if c == "token_id" else F.col(c) for c in canvas.columns])


def critic_labels(masked: DataFrame, sampled: DataFrame) -> DataFrame:
    """Critic input and target: sampled ids on hidden positions, 1.0 where they are wrong."""
    joined = masked.join(sampled.select("sample_id", "pos", "pred_id"), ["sample_id", "pos"], "left")
    shown = where_masked(F.col("masked"), F.col("pred_id"), F.col("x"))
    wrong = (F.col("token_id") != F.col("critic_input")).cast("double")
    return joined.withColumn("critic_input", shown).select(
        "sample_id", "pos", "critic_input", wrong.alias("critic_label")
    )


def condition_dropout(context: DataFrame, p: float, seed: int) -> DataFrame:
    """Switch all context rows of a sample off with probability ``p`` (one draw per sample)."""
    kept = F.col("usable") & prob_mask(1.0 - p, seed, "sample_id")
    return context.select(*[kept.alias(c) if c == "usable" else F.col(c) for c in context.columns])
