"""Working with logits ``(sample_id, pos, token_id, logit)``; an absent row is minus infinity.

The key of a distribution is ``(sample_id, pos)`` by default.  Operators take
``keys`` so that one distribution shared by many samples (for example per
condition and position) is worked out once instead of per sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotgrid.functions.keyed import gumbel_noise, uniform
from spotgrid.operators.masking import SETTLED_SCORE
from spotgrid.plans.sizing import join_shared

# Share of logits removed, guidance scale, temperature floor.
TOPK_THRES = 0.9
GUIDANCE = 3.0
TEMPERATURE_FLOOR = 1e-10

SAMPLE_KEYS = ("sample_id", "pos")


def kept_logits(vocab: int, thres: float = TOPK_THRES) -> int:
    """How many logits survive the filter; ``vocab`` is the whole vocabulary, not the rows present."""
    return math.ceil((1 - thres) * vocab)


def topk_filter(logits: DataFrame, vocab: int, thres: float = TOPK_THRES, keys: tuple[str, ...] = SAMPLE_KEYS) -> DataFrame:
    """Keep the highest logits of every distribution; ties go to the lower token."""
    order = Window.partitionBy(*keys).orderBy(F.desc("logit"), F.asc("token_id"))
    ranked = logits.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= kept_logits(vocab, thres)).drop("_rank")


def noisy_logit(logit: Column, temperature: float, seed: int, *keys: str | int | Column) -> Column:
    """Logit over temperature plus keyed Gumbel noise."""
    return logit / F.lit(max(float(temperature), TEMPERATURE_FLOOR)) + gumbel_noise(uniform(seed, *keys))


def gumbel_argmax(
    logits: DataFrame, temperature: float, seed: int, keys: tuple[str, ...] = SAMPLE_KEYS, salt: tuple = ()
) -> DataFrame:
    """Sample one token per distribution: ``(*keys, pred_id)``; temperature 0 is greedy in practice."""
    value = noisy_logit(F.col("logit"), temperature, seed, *salt, *keys, "token_id")
    best = F.max(F.struct(value.alias("v"), (-F.col("token_id")).alias("t")))
    return logits.groupBy(*keys).agg(best.alias("best")).select(*keys, (-F.col("best.t")).alias("pred_id"))


def log_normalizer(logits: DataFrame, keys: tuple[str, ...] = SAMPLE_KEYS) -> DataFrame:
    """``(*keys, logz)``: log of the sum of exponentials, shifted by the maximum.

    Window and aggregate share one shuffle on the keys.
    """
    peaked = logits.withColumn("_peak", F.max("logit").over(Window.partitionBy(*keys)))
    total = F.sum(F.exp(F.col("logit") - F.col("_peak")))
    return peaked.groupBy(*keys).agg((F.max("_peak") + F.log(total)).alias("logz"))


def log_softmax(logits: DataFrame, keys: tuple[str, ...] = SAMPLE_KEYS) -> DataFrame:
    """``(*keys, token_id, logp)``: the log probability of every token, with one shuffle on the keys."""
    whole = Window.partitionBy(*keys)
    peaked = logits.select(*keys, "token_id", "logit", F.max("logit").over(whole).alias("_peak"))
    total = F.sum(F.exp(F.col("logit") - F.col("_peak"))).over(whole)
    return peaked.select(*keys, "token_id", (F.col("logit") - F.col("_peak") - F.log(total)).alias("logp"))


def log_prob_at(logits: DataFrame, picked: DataFrame, column: str, keys: tuple[str, ...] = SAMPLE_KEYS) -> DataFrame:
    """Add ``logp`` to ``picked``: the log probability of the token in ``column``, null if it has no logit.

    Distributions that many samples share are worked out once; how they meet the
    samples follows from counts, see :func:`spotgrid.plans.sizing.join_shared`.
    """
    at = log_softmax(logits, keys).withColumnRenamed("token_id", column)
    on = [*keys, column]
    joined = picked.join(at, on, "left") if tuple(keys) == SAMPLE_KEYS else join_shared(picked, at, on, "left")
    return joined.select(*[joined[c] for c in picked.columns], "logp")


def softmax_at(logits: DataFrame, picked: DataFrame, column: str, keys: tuple[str, ...] = SAMPLE_KEYS) -> DataFrame:
    """Add ``prob`` to ``picked``: the softmax of the token in ``column`` under its distribution.

    A token without a logit row has probability zero.
    """
    prob = F.coalesce(F.exp("logp"), F.lit(0.0))
    return log_prob_at(logits, picked, column, keys).select(*picked.columns, prob.alias("prob"))


def confidence_scores(
    canvas: DataFrame,
    logits: DataFrame,
    pred: DataFrame,
    can_remask: bool = False,
    keys: tuple[str, ...] = SAMPLE_KEYS,
) -> DataFrame:
    """``(sample_id, pos, score)``: one minus the softmax of the prediction.

    ``logits`` are the unfiltered ones.  ``canvas`` has ``was_masked`` and the
    ``keys``; positions that were not hidden get the settled score unless
    ``can_remask``.
    """
    joined = canvas.join(pred.select("sample_id", "pos", "pred_id"), ["sample_id", "pos"], "left")
    score = F.lit(1.0) - F.col("prob")
    if not can_remask:
        score = F.when(F.col("was_masked"), score).otherwise(F.lit(SETTLED_SCORE))
    return softmax_at(logits, joined, "pred_id", keys).select("sample_id", "pos", score.alias("score"))


def predict(
    logits: DataFrame, vocab: int, thres: float, temperature: float, seed: int, salt: tuple = ()
) -> DataFrame:
    """Filter, sample and rate in one pass: ``(sample_id, pos, pred_id, prob)``.

    Same result as :func:`topk_filter`, :func:`gumbel_argmax` and
    :func:`softmax_at` one after the other, but the logits are read once and
    shuffled once.
    """
    keys = list(SAMPLE_KEYS)
    order = Window.partitionBy(*keys).orderBy(F.desc("logit"), F.asc("token_id"))
    ranked = logits.select(*keys, "token_id", "logit", F.row_number().over(order).alias("_rank"), F.first("logit").over(order).alias("_peak"))
    value = noisy_logit(F.col("logit"), temperature, seed, *salt, *keys, "token_id")
    mass = F.exp(F.col("logit") - F.col("_peak"))
    entry = F.struct(value.alias("v"), (-F.col("token_id")).alias("t"), mass.alias("mass"))
    kept = F.when(F.col("_rank") <= kept_logits(vocab, thres), entry)
    found = ranked.groupBy(*keys).agg(F.max(kept).alias("best"), F.sum(mass).alias("total"))
    return found.select(*keys, (-F.col("best.t")).alias("pred_id"), (F.col("best.mass") / F.col("total")).alias("prob"))


def critic_noise(score: Column, left: int, timesteps: int, noise_scale: float, seed: int, *keys) -> Column:
    """Critic score with annealed uniform noise."""
    return score + (uniform(seed, *keys) - F.lit(0.5)) * F.lit(float(noise_scale)) * F.lit(left / timesteps)


def critic_scores(
    critic: DataFrame, step: int, timesteps: int, seed: int, noise_scale: float = 1.0
) -> DataFrame:
    """``(sample_id, pos, score)`` from critic logits ``(sample_id, pos, score)`` at one step."""
    left = timesteps - 1 - step
    score = critic_noise(F.col("score"), left, timesteps, noise_scale, seed, step, "sample_id", "pos")
    return critic.select("sample_id", "pos", score.alias("score"))


def guided(cond: Column, null: Column, scale: float) -> Column:
    """Move from the null logit toward (and past) the conditional one."""
    return cond if scale == 1 else null + (cond - null) * F.lit(float(scale))


def guide(
    cond: DataFrame, null: DataFrame, scale: float = GUIDANCE, floor: float | None = None, keys: tuple[str, ...] = SAMPLE_KEYS
) -> DataFrame:
    """Combine conditional and null logits per token.

    A token without a conditional row has probability zero and stays out.  With
    ``floor`` a row missing on either side counts as that logit instead.
    """
    if scale == 1:
        return cond.select(*keys, "token_id", "logit")
    on = [*keys, "token_id"]
    joined = cond.select(*on, F.col("logit").alias("_c")).join(
        null.select(*on, F.col("logit").alias("_n")), on, "left" if floor is None else "full"
    )
    if floor is None:
        return joined.select(*on, guided(F.col("_c"), F.coalesce("_n", "_c"), scale).alias("logit"))
    c, n = F.coalesce("_c", F.lit(float(floor))), F.coalesce("_n", F.lit(float(floor)))
    return joined.select(*on, guided(c, n, scale).alias("logit"))


def guide_negative(pos: DataFrame, neg: DataFrame, scale: float, floor: float, keys: tuple[str, ...] = SAMPLE_KEYS) -> DataFrame:
    """Move away from the logits of a negative condition; missing rows count as ``floor``."""
    on = [*keys, "token_id"]
    joined = pos.select(*on, F.col("logit").alias("_p")).join(neg.select(*on, F.col("logit").alias("_n")), on, "full")
    p, n = F.coalesce("_p", F.lit(float(floor))), F.coalesce("_n", F.lit(float(floor)))
    return joined.select(*on, (n + (p - n) * F.lit(float(scale))).alias("logit"))
