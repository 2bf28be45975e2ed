import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spotgrid.functions.keyed import uniform
from spotgrid.operators import decoding, generating, masking, scoring


def tokens(spark, samples=6, length=16, vocab=9):
    return spark.range(samples * length).select(
        F.expr(f"id div {length}").cast("long").alias("sample_id"),
        (F.col("id") % length).cast("int").alias("pos"),
        F.floor(uniform(2, "id") * vocab).cast("int").alias("token_id"),
    )


def conditions(spark, samples=6):
    return spark.range(samples).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("long").alias("cond"))


@pytest.fixture(scope="module")
def scorer(spark):
    return scoring.fit_token_scorer(tokens(spark), conditions(spark), 0.5)


def test_mask_sizes_and_labels(spark):
    got = masking.mask_tokens(tokens(spark), 9, 4)
    draws = {r[0]: r[1] for r in spark.range(6).select("id", uniform(4, "id")).collect()}
    hidden = {r[0]: r[1] for r in got.groupBy("sample_id").agg(F.count_if("masked")).collect()}
    for sample, m in hidden.items():
        exact = math.cos(draws[sample] * math.pi / 2) * 16
        assert m == max(1, round(exact))
    assert got.where("masked and (x != 9 or label != token_id)").count() == 0
    assert got.where("not masked and (x != token_id or label != -1)").count() == 0
    assert rows(got) == rows(masking.mask_tokens(tokens(spark).repartition(7), 9, 4))


def test_no_mask_prob_shows_exact_share(spark):
    got = masking.mask_tokens(tokens(spark), 9, 4, no_mask_prob=0.4)
    per_sample = got.groupBy("sample_id").agg(F.count_if("masked").alias("m"), F.count_if(F.expr("masked and x != 9")).alias("shown"))
    for r in per_sample.collect():
        assert r["shown"] == math.ceil(r["m"] * 0.4)
    assert got.where("masked and label != token_id").count() == 0


def test_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(F.greatest(F.bround("v"), F.lit(1.0)))
    assert [r[0] for r in got.collect()] == [1.0, 2.0, 2.0]


def test_remask_ties_and_fill(spark):
    canvas = spark.createDataFrame([(0, 0, 5, 0.5), (0, 1, 6, 0.5), (0, 2, 7, 0.9), (0, 3, 8, 0.1)], "sample_id long, pos int, token_id int, score double")
    hidden = masking.remask_topk(canvas, 2, 99)
    assert [r[2] for r in rows(hidden)] == [99, 6, 99, 8]
    pred = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 3)], "sample_id long, pos int, pred_id int")
    assert [r[2] for r in rows(masking.fill_masked(hidden, pred, 99))] == [1, 6, 99, 8]


def test_guidance(spark):
    layout = "sample_id long, pos int, token_id int, logit double"
    cond = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, 1.0)], layout)
    null = spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 3, 0.5)], layout)
    assert rows(decoding.guide(cond, null, 1)) == rows(cond)
    assert [r[2:] for r in rows(decoding.guide(cond, null, 3))] == [(1, 4.0), (2, 1.0)]
    assert [r[2:] for r in rows(decoding.guide(cond, null, 3, floor=0.0))] == [(1, 4.0), (2, 3.0), (3, -1.0)]
    assert [r[2:] for r in rows(decoding.guide_negative(cond, null, 2, 0.0))] == [(1, 3.0), (2, 2.0), (3, -0.5)]


def test_softmax_sums_to_one(spark, scorer):
    logits = scorer.guided(3.0)
    z = decoding.log_normalizer(logits, ("cond", "pos"))
    total = logits.join(z, ["cond", "pos"]).groupBy("cond", "pos").agg(F.sum(F.exp(F.col("logit") - F.col("logz"))).alias("s"))
    assert total.where("abs(s - 1) > 1e-9").count() == 0


def test_fused_prediction_equals_the_steps(spark, scorer):
    hidden = tokens(spark).join(conditions(spark), "sample_id")
    logits = scoring.score_function(scorer, 3.0)(hidden)
    fused = decoding.predict(logits, 9, 0.6, 0.7, 5, (3,))
    pred = decoding.gumbel_argmax(decoding.topk_filter(logits, 9, 0.6), 0.7, 5, salt=(3,))
    slow = decoding.softmax_at(logits, pred, "pred_id")
    a, b = rows(fused), rows(slow.select("sample_id", "pos", "pred_id", "prob"))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert all(math.isclose(x[3], y[3], rel_tol=1e-9) for x, y in zip(a, b))


def test_zero_temperature_is_greedy(spark, scorer):
    logits = scorer.guided(3.0)
    best = logits.groupBy("cond", "pos").agg(F.max("logit").alias("best"))
    pred = decoding.gumbel_argmax(logits, 0.0, 1, ("cond", "pos"))
    got = pred.join(logits, (pred.cond == logits.cond) & (pred.pos == logits.pos) & (pred.pred_id == logits.token_id))
    got = got.select(pred.cond, pred.pos, "logit").join(best, ["cond", "pos"])
    assert got.where("logit < best - 1e-9").count() == 0 and got.count() == best.count()


def run(**kw):
    return generating.Decoding(side=4, vocab=9, seed=8, **{"timesteps": 5, "thres": 0.5, "sampler": "gumbel", **kw})


def check_full(got):
    assert got.count() == 6 * 16 and got.where("token_id = 9").count() == 0
    assert got.select("sample_id", "pos").distinct().count() == 6 * 16


def test_generation_table_and_general_paths_agree(spark, scorer):
    by_table = generating.generate(conditions(spark), scorer, run(cut_every=2))
    saved = scorer.saved()
    general = generating.generate(conditions(spark), scoring.score_function(saved, 3.0), run())
    check_full(by_table)
    assert rows(by_table) == rows(general)
    assert rows(by_table) == rows(generating.generate(conditions(spark).repartition(5), scorer, run(cut_every=5)))


def test_generation_without_and_with_unknown_condition(spark, scorer):
    check_full(generating.generate(conditions(spark).select("sample_id"), scorer, run(timesteps=3)))
    odd = conditions(spark).withColumn("cond", F.col("cond") + 70)
    assert rows(generating.generate(odd, scorer, run(timesteps=3))) == rows(
        generating.generate(conditions(spark).select("sample_id"), scorer, run(timesteps=3))
    )


def test_generation_with_negative_conditions(spark, scorer):
    pairs = conditions(spark).withColumn("neg_cond", F.lit(1) - F.col("cond"))
    by_table = generating.generate(pairs, scorer, run(timesteps=3))
    check_full(by_table)
    general = generating.generate(pairs, scoring.score_function(scorer.saved(), 3.0, generating.MISSING_LOGIT), run(timesteps=3))
    assert rows(by_table) == rows(general)
    assert rows(by_table) != rows(generating.generate(conditions(spark), scorer, run(timesteps=3)))


def test_settled_positions_stay(spark, scorer, tmp_path):
    path = str(tmp_path / "canvas")
    generating.generate(conditions(spark), scorer, run(cut_every=1), snapshots=path)
    from spotgrid.sinks.snapshots import load_snapshot, saved_steps

    assert saved_steps(spark, path) == [0, 1, 2, 3, 4]
    sizes = [s.hidden for s in masking.schedule_steps(16, 5)]
    for step in range(1, 5):
        before, after = load_snapshot(spark, path, step - 1), load_snapshot(spark, path, step)
        both = before.alias("b").join(after.alias("a"), ["sample_id", "pos"])
        changed = both.where("a.token_id != b.token_id").groupBy("sample_id").count()
        assert all(r["count"] <= sizes[step] for r in changed.collect())
        assert after.where("score > -1e4").groupBy("sample_id").count().where(f"count != {sizes[step]}").count() == 0


def test_generation_resumes(spark, scorer, tmp_path):
    import shutil

    path, half = str(tmp_path / "whole"), tmp_path / "half"
    whole = rows(generating.generate(conditions(spark), scorer, run(cut_every=2), snapshots=path))
    half.mkdir()
    shutil.copytree(f"{path}/step=1", half / "step=1")
    assert rows(generating.generate(conditions(spark), scorer, run(cut_every=2), snapshots=str(half))) == whole


def test_generation_with_critic_and_remasking(spark, scorer):
    critic = lambda canvas: canvas.select("sample_id", "pos", uniform(77, "sample_id", "pos", "token_id").alias("score"))
    check_full(generating.generate(conditions(spark), scorer, run(timesteps=3), critic=critic))
    with pytest.raises(ValueError):
        generating.generate(conditions(spark), scorer, run(can_remask=True))
    again = run(timesteps=3, can_remask=True, no_mask_prob=0.1)
    by_table = generating.generate(conditions(spark), scorer, again)
    check_full(by_table)
    assert rows(by_table) == rows(generating.generate(conditions(spark), scoring.score_function(scorer.saved(), 3.0), again))


def test_two_stages(spark):
    from spotgrid.operators.codebook import fit_codebook
    from spotgrid.operators.raster import patch_vectors

    cells = spark.range(6 * 64).selectExpr("cast(id div 64 as int) as gene_idx", "cast(id % 64 div 8 as int) as px", "cast(id % 8 as int) as py")
    pixels = cells.withColumn("value", F.floor(uniform(6, "gene_idx", "px", "py") * 5).cast("float")).where("value != 0")
    learned = fit_codebook(patch_vectors(pixels, 8, 1), k=6, seed=2)
    codes = spark.createDataFrame(learned.collect(), learned.schema)
    fine, coarse = generating.Codec(codes, 6, 8, 1), generating.Codec(codes, 6, 4, 1)
    low = generating.lowres_tokens(pixels, 8, coarse)
    base = scoring.fit_token_scorer(low, conditions(spark))
    per_pos = generating.lowres_conditions(conditions(spark), low, coarse.side, fine.side, 6)
    assert per_pos.count() == 6 * 16
    superres = scoring.fit_token_scorer(fine.encode(pixels), per_pos)
    image, small = generating.generate_two_stage(
        conditions(spark), base, coarse, superres, fine, seed=3, timesteps=3, superres_timesteps=2, return_lowres=True, thres=0.5
    )
    assert image.agg(F.max("px"), F.max("py")).first()[0] <= 7 and small.agg(F.max("px")).first()[0] <= 3
    assert image.select("gene_idx").distinct().count() <= 6 and image.count() > 0


def test_dropout_is_per_sample(spark):
    context = tokens(spark).select("sample_id", "pos", F.lit(True).alias("usable"))
    got = masking.condition_dropout(context, 0.5, 3).groupBy("sample_id").agg(F.countDistinct("usable").alias("n"))
    assert got.where("n != 1").count() == 0
    assert masking.condition_dropout(context, 1.0, 3).where("usable").count() == 0


def test_inverse_sampler(spark, scorer):
    inverse = run(timesteps=3, sampler=None)
    got = generating.generate(conditions(spark), scorer, inverse)
    check_full(got)
    assert rows(got) == rows(generating.generate(conditions(spark).repartition(3), scorer, inverse))
    with pytest.raises(ValueError):
        generating.generate(conditions(spark), scoring.score_function(scorer, 3.0), run(sampler="inverse"))


@pytest.mark.parametrize("sampler", ["gumbel", "inverse"])
def test_samplers_follow_the_softmax(spark, sampler):
    seen = spark.createDataFrame([(0, 0, t, n) for t, n in ((0, 10), (1, 30), (2, 60))], "cond long, pos int, token_id int, n long")
    one_cell = scoring.TokenScorer(seen, 0.0)
    settings = generating.Decoding(1, 3, 5, timesteps=2, cond_scale=1.0, thres=0.0, temperature=2.0, sampler=sampler)
    # Two steps: the first samples at temperature 1, the last is greedy, so look at the first step alone.
    step = masking.Step(0, 1, 1, 1.0)
    logits, keys = one_cell.guided(1.0), ("cond", "pos")
    if sampler == "gumbel":
        cells = generating.candidate_table(logits, 3, 0.0, keys)
    else:
        cells = generating.draw_table(logits, 3, 0.0, keys, [step])
    canvas = spark.range(4000).selectExpr("id as sample_id", "0 as pos", "cast(0 as long) as cond", "3 as token_id", "0.0D as score")
    got = {r[0]: r[1] for r in rows(generating._table_step(canvas, cells, ["cond", "pos"], step, settings).groupBy("token_id").count())}
    assert all(abs(got[t] / 4000 - share) < 0.03 for t, share in ((0, 0.1), (1, 0.3), (2, 0.6)))
