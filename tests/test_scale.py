"""Bounded groups and tables kept off the driver."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spotgrid.catalog import inputs
from spotgrid.operators import generating, masking, matrix, sampling, scoring, tracking, vector_sums
from spotgrid.plans import training


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_moving_average_of_one_hot_key(spark, block):
    """One key holds almost all rows, with gaps and a late start; groups stay within a block."""
    data = [("hot", 5 + 3 * i, float(i % 11)) for i in range(200)] + [("cold", 40, 2.0), ("cold", 41, 9.0)]
    df = spark.createDataFrame(data, "k string, s long, v double")
    got = {(r["k"], r["s"]): r["ema"] for r in tracking.ema_by_key(df, "k", "s", "v", 0.9, update_after=20, update_every=2, block=block).collect()}
    for key in ("hot", "cold"):
        ema = None
        for _, s, v in sorted(d for d in data if d[0] == key):
            if s % 2 == 0:
                ema = v if ema is None or s <= 20 else 0.9 * ema + (1 - 0.9) * v
            assert got[key, s] == (pytest.approx(ema) if ema is not None else None)
    assert tracking.ema_by_key(df.where("false"), "k", "s", "v", 0.9).count() == 0


def test_groups_of_the_moving_average_are_bounded(spark):
    df = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("s"), F.lit(1.0).alias("v"))
    plan = tracking.ema_by_key(df, "k", "s", "v", 0.9, block=64)
    text = plan._jdf.queryExecution().toString()
    assert "SinglePartition" not in text.split("== Physical Plan ==")[1]
    assert plan.count() == 3000


def test_later_buckets_are_not_ordered(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    some = sampling.cycle_batches(df, "key", 32, 100, seed=3)
    assert some.count() == 3200 and some.select("step").distinct().count() == 100
    ranked = sampling.random_ranks(df, "key", 3, epoch=F.lit(0), buckets=512, most=F.lit(100))
    whole = {r["key"]: r["rank"] for r in sampling.random_ranks(df, "key", 3, epoch=F.lit(0)).collect()}
    part = {r["key"]: r["rank"] for r in ranked.collect()}
    assert len(part) < 200 and all(whole[k] == r for k, r in part.items()) and set(range(100)) <= set(part.values())


def test_large_weights_are_joined_on_executors(spark):
    counts = spark.createDataFrame([(g, c, float((g + 2 * c) % 4)) for g in range(5) for c in range(50)], "gene_idx int, cell_idx int, count float")
    weights = spark.range(50).select(F.col("id").cast("int").alias("cell_idx"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("vec"))
    small = vector_sums.sparse_times_dense(counts, "gene_idx", "cell_idx", "count", weights)
    large = vector_sums.sparse_times_dense(counts, "gene_idx", "cell_idx", "count", weights, limit=64)
    as_rows = lambda df: sorted((r["gene_idx"], r["n"], tuple(round(x, 9) for x in r["total"])) for r in df.collect())
    assert as_rows(small) == as_rows(large)
    assert matrix.project_counts(counts, weights.withColumnRenamed("vec", "w")).count() == 5


def test_unseen_tokens_have_a_finite_loss(spark):
    """Against a dense table of all tokens."""
    import math

    data = [(0, 0, 1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 1), (1, 1, 4)]
    tokens = spark.createDataFrame(data, "sample_id long, pos int, token_id int")
    conds = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "sample_id long, cond long")
    scorer = scoring.fit_token_scorer(tokens, conds, 0.5)
    labels = [(0, 0, 1), (0, 0, 3), (1, 0, 5), (0, 1, 0), (-1, 0, 2), (-1, 1, 5), (0, 0, -1)]
    df = spark.createDataFrame(labels, "cond long, pos int, label int")
    vocab, s = 6, 2.0
    cond_of = {0: 0, 1: 0, 2: 1, 3: 1}
    prior = [(sum(t == k for _, _, t in data) + 1) / (len(data) + vocab) for k in range(vocab)]

    def logits(cond, pos):
        out = []
        for k in range(vocab):
            bare = math.log(sum(p == pos and t == k for _, p, t in data) + 0.5 * prior[k])
            own = math.log(sum(p == pos and t == k and cond_of[i] == cond for i, p, t in data) + 0.5 * prior[k])
            out.append(bare if cond == -1 else bare + (own - bare) * s)
        return out

    want = [math.log(sum(map(math.exp, logits(c, p)))) - logits(c, p)[k] for c, p, k in labels if k != -1]
    assert scorer.cross_entropy(df, vocab, s).first()["loss"] == pytest.approx(sum(want) / len(want))


def test_training_goes_on_after_its_snapshots(spark, tmp_path):
    data = [(i, p, (i * 3 + p) % 5) for i in range(40) for p in range(4)]
    tokens = spark.createDataFrame(data, "sample_id long, pos int, token_id int")
    conds = spark.createDataFrame([(i, i % 3) for i in range(40)], "sample_id long, cond long")
    settings = dict(valid_frac=0.25, seed=2, dropout=0.3, no_mask_prob=0.2)
    whole, metrics = training.train_flow(tokens, conds, 5, 14, 6, str(tmp_path / "a"), **settings)
    assert [(r["step"], r["epoch"]) for r in metrics.collect()] == [(4, 1), (9, 2)]
    training.train_flow(tokens, conds, 5, 5, 6, str(tmp_path / "b"), **settings)
    again, later = training.train_flow(tokens, conds, 5, 14, 6, str(tmp_path / "b"), **settings)
    assert [(r["step"], r["epoch"]) for r in later.collect()] == [(9, 2)]
    assert rows(whole.seen.select("cond", "pos", "token_id", "n")) == rows(again.seen.select("cond", "pos", "token_id", "n"))
    assert later.first()["value"] == pytest.approx(metrics.where("epoch = 2").first()["value"])


def test_shared_join_deals_a_hot_key_over_salts(spark):
    """One (cond, pos) holds nine of ten rows: no salt of it has more rows than allowed, and nothing is lost."""
    from spotgrid.plans import sizing

    rows = spark.range(5000).selectExpr("id as sample_id", "case when id % 10 = 0 then id % 7 else 1 end as cond", "cast(case when id % 10 = 0 then id % 3 else 2 end as int) as pos")
    shared = spark.createDataFrame([(c, p, t, float(c * 10 + p + t)) for c in range(6) for p in range(3) for t in range(4)], "cond long, pos int, token_id int, logit double")
    for how in ("inner", "left"):
        plain = rows.join(shared, ["cond", "pos"], how)
        for limit in (1, sizing.BROADCAST_LIMIT):
            got = sizing.join_shared(rows, shared, ["cond", "pos"], how, limit, key_rows=300)
            assert sorted(map(repr, got.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    dealt, copied = sizing.salted(rows, shared, ["cond", "pos"], 300)
    sizes = {}
    for r in dealt.groupBy("cond", "pos", "_salt").count().collect():
        sizes.setdefault((r["cond"], r["pos"]), []).append(r["count"])
    assert len(sizes[1, 2]) >= 15 and max(map(max, sizes.values())) < 400
    assert copied.where("cond = 1 and pos = 2").count() == 4 * len(sizes[1, 2]) and copied.where("cond = 2").count() == 12
    with pytest.raises(ValueError):
        sizing.join_shared(rows, shared, ["cond"], "full")


def test_draws_search_the_running_sums(spark):
    """The candidate of a draw is the first whose edge exceeds it, whatever the number of candidates."""
    from spotgrid.functions.keyed import uniform

    for kept in (1, 2, 7, 100):
        edges = [(i + 1) ** 2 / kept**2 for i in range(kept)]
        run = generating.Decoding(2, kept * 10, 3)
        step = masking.schedule_steps(4, 2)[0]
        frame = spark.range(300).selectExpr("id as sample_id", "cast(id % 4 as int) as pos").withColumn("u", uniform(3, step.index, "sample_id", "pos"))
        arrays = {"tokens": F.array(*map(F.lit, range(kept))), "probs": F.array(*[F.lit(0.5)] * kept), f"edges_{step.index}": F.array(*map(F.lit, edges))}
        for r in frame.withColumns(arrays).withColumn("best", generating._inverse_pick(step, run)).collect():
            assert r["best"]["token"] == sum(e <= r["u"] for e in edges)


def test_settled_positions_leave_the_canvas(spark, monkeypatch):
    """Steps after a cut see open positions only; the tokens are those of one uncut run."""
    samples = spark.createDataFrame([(i, i % 3) for i in range(12)], "sample_id long, cond long")
    tokens = spark.range(12 * 16).selectExpr("id div 16 as sample_id", "cast(id % 16 as int) as pos", "cast((id * 7 + id div 16) % 5 as int) as token_id")
    scorer = scoring.fit_token_scorer(tokens, samples)
    want = {tuple(r) for r in generating.generate(samples, scorer, generating.Decoding(4, 5, 9, timesteps=8, cut_every=99)).collect()}
    seen, plain = [], generating._table_step
    monkeypatch.setattr(generating, "_table_step", lambda canvas, *a: seen.append(canvas.count()) or plain(canvas, *a))
    got = {tuple(r) for r in generating.generate(samples, scorer, generating.Decoding(4, 5, 9, timesteps=8, cut_every=2)).collect()}
    assert got == want and len(got) == 12 * 16
    assert seen[0] == 192 and seen[-1] < 96 and seen == sorted(seen, reverse=True)
    joined = plain(masking.init_canvas(samples, 4, 5).join(samples, "sample_id").where("sample_id is not null"), generating.cut_lineage(generating.draw_table(scorer.guided(3.0), 5, 0.1, ("cond", "pos"), masking.schedule_steps(16, 8))), ["cond", "pos"], masking.schedule_steps(16, 8)[4], generating.Decoding(4, 5, 9, timesteps=8, sampler="inverse"), False)
    assert joined.where("sample_id is null or pos is null").count() == 0 and joined.count() == 192


def test_what_is_rated_is_what_is_drawn_from(spark, tmp_path):
    """A trained scorer's logits have the prior of its loss: shares of tokens by both ways agree."""
    import math

    data = [(i, p, (i * 3 + p * p) % 4) for i in range(20) for p in range(3)]
    tokens = spark.createDataFrame(data, "sample_id long, pos int, token_id int")
    conds = spark.createDataFrame([(i, i % 2) for i in range(20)], "sample_id long, cond long")
    scorer, _ = training.train_flow(tokens, conds, 6, 4, 5, str(tmp_path / "f"), valid_frac=0)
    counts = {}
    for r in scorer.seen.collect():
        counts[r["token_id"]] = counts.get(r["token_id"], 0) + r["n"]
    total = sum(counts.values())
    seen = {(r["cond"], r["pos"], r["token_id"]): r["n"] for r in scorer.seen.collect()}
    for r in scorer.cond.collect():
        assert math.exp(r["logit"]) == pytest.approx(seen[r["cond"], r["pos"], r["token_id"]] + (counts[r["token_id"]] + 1) / (total + 6))
    # The loss of one label is the softmax of these masses over all tokens, those never seen included.
    (cond, pos, token), n = next(iter(sorted(seen.items())))
    mass = lambda t: seen.get((cond, pos, t), 0) + (counts.get(t, 0) + 1) / (total + 6)
    label = spark.createDataFrame([(cond, pos, token)], "cond long, pos int, label int")
    assert scorer.cross_entropy(label, 6, scale=1.0).first()[0] == pytest.approx(-math.log(mass(token) / sum(mass(t) for t in range(6))))


def test_settled_positions_are_not_drawn_again(spark, monkeypatch):
    samples = spark.createDataFrame([(i, i % 3) for i in range(6)], "sample_id long, cond long")
    tokens = spark.range(6 * 16).selectExpr("id div 16 as sample_id", "cast(id % 16 as int) as pos", "cast((id * 7 + id div 16) % 5 as int) as token_id")
    scorer = scoring.fit_token_scorer(tokens, samples)
    pick = generating._inverse_pick
    hidden_only = lambda step, run: F.when(F.col("_hide"), pick(step, run)).otherwise(F.raise_error(F.lit("a settled position was drawn")))
    want = {tuple(r) for r in generating.generate(samples, scorer, generating.Decoding(4, 5, 9, timesteps=6)).collect()}
    monkeypatch.setattr(generating, "_inverse_pick", hidden_only)
    got = {tuple(r) for r in generating.generate(samples, scorer, generating.Decoding(4, 5, 9, timesteps=6)).collect()}
    assert got == want and len(got) == 6 * 16


def test_the_codebook_of_queries_is_worked_out_once(spark):
    plan = inputs.codebook(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("LogicalRDD") and "Aggregate" not in plan
