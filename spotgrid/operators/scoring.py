"""A count-based token scorer: which token is likely at a position under a condition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotgrid.operators.decoding import GUIDANCE, guide, guided
from spotgrid.operators.masking import IGNORE_INDEX
from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import join_shared

# Condition of rows that stand for "no condition".
NULL_COND = -1

COND_KEYS = ("cond", "pos")

# A pluggable scorer: rows (sample_id, pos, token_id, cond) to guided logits (sample_id, pos, token_id, logit).
ScoreFunction = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class TokenScorer:
    """Token counts ``seen(cond, pos, token_id, n)`` and the smoothing weight; logit tables follow.

    With ``vocab``, the size of the vocabulary, logits have the prior that
    :meth:`cross_entropy` rates, with one added to every token's count; the training
    flows set it, so that what they rate is what is drawn from.
    """

    seen: DataFrame
    alpha: float
    vocab: int | None = None

    def saved(self) -> TokenScorer:
        """The same scorer with its counts materialised, for repeated use."""
        return TokenScorer(cut_lineage(self.seen), self.alpha, self.vocab)

    @property
    def prior(self) -> DataFrame:
        """``(token_id, p)``: share of every token that was seen."""
        if self.vocab is not None:
            return self.smoothed_prior(self.vocab)
        by_token = self.seen.groupBy("token_id").agg(F.sum("n").alias("_n"))
        total = self.seen.agg(F.sum("n").alias("_total"))
        return by_token.crossJoin(F.broadcast(total)).select("token_id", (F.col("_n") / F.col("_total")).alias("p"))

    def _logits(self, counts: DataFrame) -> DataFrame:
        logit = F.log(F.col("n") + F.lit(float(self.alpha)) * F.col("p"))
        return counts.join(self.prior, "token_id").withColumn("logit", logit)

    @property
    def cond(self) -> DataFrame:
        """``(cond, pos, token_id, logit)``; tokens counted without a condition are not listed."""
        return self._logits(self.seen.where(F.col("cond") != NULL_COND)).select("cond", "pos", "token_id", "logit")

    @property
    def null(self) -> DataFrame:
        """``(pos, token_id, logit)`` whatever the condition."""
        counts = self.seen.groupBy("pos", "token_id").agg(F.sum("n").alias("n"))
        return self._logits(counts).select("pos", "token_id", "logit")

    def smoothed_prior(self, vocab: int) -> DataFrame:
        """``(token_id, p)`` of the tokens seen, one added to the count of each of ``vocab`` tokens.

        A token that is not listed has ``1 / (total + vocab)``, see :meth:`_total`.
        """
        by_token = self.seen.groupBy("token_id").agg(F.sum("n").alias("_n"))
        share = (F.col("_n") + 1) / (F.col("_total") + F.lit(vocab))
        return by_token.crossJoin(F.broadcast(self._total())).select("token_id", share.alias("p"))

    def _total(self) -> DataFrame:
        return self.seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))

    def cross_entropy(
        self, labels: DataFrame, vocab: int, scale: float = GUIDANCE, ignore_index: int = IGNORE_INDEX, by: tuple[str, ...] = ()
    ) -> DataFrame:
        """One-row ``loss`` over ``labels(cond, pos, label)``: the guided mean cross entropy over all ``vocab`` tokens.

        With ``by``, columns of ``labels``, one row for each of their values.

        Every token has the mass ``n + alpha * p`` with and without the condition, so
        a label that was never seen has a finite loss.  No dense table is made: the
        tokens without a count under a condition add a sum that depends on the
        position alone, and those without any count add what is left of ``alpha``.
        Labels have resolved conditions, see :func:`resolve_conditions`.
        """
        alpha, s = F.lit(float(self.alpha)), F.lit(float(scale))
        prior = self.smoothed_prior(vocab)
        null = self.seen.groupBy("pos", "token_id").agg(F.sum("n").alias("n0")).join(prior, "token_id")
        null = null.select("pos", "token_id", (F.col("n0") + alpha * F.col("p")).alias("m0"), (alpha * F.col("p")).alias("m"))
        away = F.pow("m0", 1 - s) * F.pow("m", s)  # guided mass of a token without a count under the condition
        rest = null.groupBy("pos").agg((alpha - F.sum("m")).alias("unseen"), F.sum(away).alias("away"), F.sum("m0").alias("null_mass"))
        cells = self.seen.where(F.col("cond") != NULL_COND).join(null, ["pos", "token_id"]).withColumn("mc", F.col("n") + F.col("m"))
        mass = F.pow("m0", 1 - s) * F.pow("mc", s)
        more = cells.groupBy("cond", "pos").agg(F.sum(mass - away).alias("more"))
        null_cond = F.lit(NULL_COND).cast("long")
        norms = more.join(rest, "pos").select("cond", "pos", (F.col("unseen") + F.col("away") + F.col("more")).alias("z"))
        norms = norms.unionByName(rest.select(null_cond.alias("cond"), "pos", (F.col("unseen") + F.col("null_mass")).alias("z")))
        wanted = labels.where(F.col("label") != ignore_index).select(*by, F.col("cond").cast("long").alias("cond"), "pos", F.col("label").alias("token_id"))
        at = wanted.join(cells.select("cond", "pos", "token_id", "mc"), ["cond", "pos", "token_id"], "left")
        at = at.join(null.select("pos", "token_id", "m0"), ["pos", "token_id"], "left").join(prior, "token_id", "left")
        at = at.crossJoin(F.broadcast(self._total())).join(norms, ["cond", "pos"], "left")
        m = alpha * F.coalesce("p", 1 / (F.col("_total") + F.lit(vocab)))
        bare = F.coalesce("m0", m)
        own = F.when(F.col("cond") == null_cond, bare).otherwise(F.coalesce("mc", m))
        guided_mass = F.log(bare) + (F.log(own) - F.log(bare)) * s
        loss = F.avg(F.log(F.coalesce("z", alpha)) - guided_mass).alias("loss")
        return at.groupBy(*by).agg(loss) if by else at.agg(loss)

    def with_null(self) -> DataFrame:
        """Null logits under the null condition, in the layout of ``cond``."""
        return self.null.select(F.lit(NULL_COND).cast("long").alias("cond"), "pos", "token_id", "logit")

    def pairs(self) -> DataFrame:
        """``(cond, pos, token_id, cond_logit, null_logit)``, null condition included."""
        null = self.null.withColumnRenamed("logit", "null_logit")
        seen = self.cond.withColumnRenamed("logit", "cond_logit").join(null, ["pos", "token_id"])
        columns = ["cond", "pos", "token_id", "cond_logit", "null_logit"]
        bare = self.with_null().select(
            "cond", "pos", "token_id", F.col("logit").alias("cond_logit"), F.col("logit").alias("null_logit")
        )
        return seen.select(*columns).unionByName(bare)

    def guided(self, scale: float) -> DataFrame:
        """Guided logits ``(cond, pos, token_id, logit)``, worked out once per condition and position."""
        logit = guided(F.col("cond_logit"), F.col("null_logit"), scale)
        return self.pairs().select("cond", "pos", "token_id", logit.alias("logit"))

    def away_from(self, pairs: DataFrame, scale: float, floor: float) -> DataFrame:
        """Logits of ``pairs(cond, neg_cond)`` guided away from the negative condition.

        Returns ``(cond, neg_cond, pos, token_id, logit)``; a token seen under one
        side only counts as ``floor`` on the other.
        """
        every = self.cond.unionByName(self.with_null())
        keys = ["cond", "neg_cond", "pos", "token_id"]
        pos_side = pairs.join(every, "cond").select(*keys, F.col("logit").alias("logit"))
        other = every.withColumnRenamed("cond", "neg_cond")
        neg_side = pairs.join(other, "neg_cond").select(*keys, F.col("logit").alias("logit"))
        on = ("cond", "neg_cond", "pos")
        return guide(pos_side, neg_side, scale, floor=floor, keys=on)


def fit_token_scorer(tokens: DataFrame, conditions: DataFrame, alpha: float = 1.0, vocab: int | None = None) -> TokenScorer:
    """Smoothed counts ``ln(n + alpha * p(token))`` with and without the condition.

    ``conditions(sample_id[, pos], cond)``.  Tokens are read once and counted by
    (cond, pos, token) with map-side partials; null and prior tables roll those
    counts up again.
    """
    on = ["sample_id", "pos"] if "pos" in conditions.columns else ["sample_id"]
    joined = tokens.join(conditions, on)
    cond = F.col("cond").cast("long").alias("cond")
    return TokenScorer(joined.groupBy(cond, "pos", "token_id").agg(F.count(F.lit(1)).alias("n")), alpha, vocab)


def resolve_conditions(rows: DataFrame, scorer: TokenScorer, column: str = "cond") -> DataFrame:
    """Replace a condition the scorer has never seen at a position by the null condition."""
    known = scorer.seen.select(F.col("cond").alias(column), "pos").distinct().withColumn("_known", F.lit(True))
    joined = rows.withColumn(column, F.col(column).cast("long")).join(known, [column, "pos"], "left")
    cond = F.when(F.col("_known"), F.col(column)).otherwise(F.lit(NULL_COND).cast("long"))
    return joined.select(*[cond.alias(c) if c == column else F.col(c) for c in rows.columns])


def score_tokens(rows: DataFrame, scorer: TokenScorer) -> DataFrame:
    """Candidate logits of hidden positions: ``(sample_id, pos, token_id, cond_logit, null_logit)``.

    ``rows(sample_id, pos, cond)`` are the hidden positions with resolved
    conditions.  How the shared logits meet them follows from counts.
    """
    joined = join_shared(rows.select("sample_id", "pos", "cond"), scorer.pairs(), list(COND_KEYS))
    return joined.select("sample_id", "pos", "token_id", "cond_logit", "null_logit")


def score_function(scorer: TokenScorer, scale: float = GUIDANCE, floor: float = 0.0) -> ScoreFunction:
    """The scorer as a pluggable function over canvas rows.

    Rows with ``neg_cond`` are guided away from it, with ``floor`` for tokens
    seen on one side only.
    """

    def score(rows: DataFrame) -> DataFrame:
        if "neg_cond" in rows.columns:
            pairs = rows.select("cond", "neg_cond").distinct()
            logits = scorer.away_from(pairs, scale, floor)
            joined = rows.select("sample_id", "pos", "cond", "neg_cond").join(logits, ["cond", "neg_cond", "pos"])
            return joined.select("sample_id", "pos", "token_id", "logit")
        logit = guided(F.col("cond_logit"), F.col("null_logit"), scale)
        return score_tokens(rows, scorer).select("sample_id", "pos", "token_id", logit.alias("logit"))

    return score
