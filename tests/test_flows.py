import math

from conftest import rows
from pyspark.sql import functions as F

from spotgrid.functions.keyed import uniform
from spotgrid.operators import generating, matrix
from spotgrid.plans import dataset, training
from spotgrid.sinks.snapshots import saved_steps
from spotgrid.sources import files


def write_dataset(folder, spots=60, genes=5, cells=8):
    body = ["\t".join(str((s * 7 + g * 3) % 6) for g in range(genes)) for s in range(spots)]
    (folder / files.INSITU_FILE).write_text("\n".join(["\t".join(f"g{g}" for g in range(genes)), *body]) + "\n")
    where = [f"{(s * 13) % 17}\t{(s * 5) % 11}" for s in range(spots)]
    (folder / files.LOCATION_FILE).write_text("\n".join(["x\ty", *where]) + "\n")
    lines = [f"g{g}," + ",".join(str((g * 5 + c) % 4) for c in range(cells)) for g in range(genes)]
    (folder / files.SCRNA_FILE).write_text("\n".join([",".join(["", *(f"c{c}" for c in range(cells))]), *lines]) + "\n")


def test_files_to_generated_maps(spark, tmp_path):
    from spotgrid.operators.codebook import fit_codebook
    from spotgrid.operators.raster import patch_vectors
    from spotgrid.plans.session import cut_lineage

    write_dataset(tmp_path)
    samples = dataset.read_samples(spark, str(tmp_path), 8)
    assert samples.pairs().select("gene_idx").distinct().count() == 5
    one = samples.arrays(8).where("gene_idx = 1").first()
    assert len(one["counts"]) == 8 and len(one["image"]) == 64 and list(one["counts"])[:4] == [1, 2, 3, 0]

    cells = samples.counts.select("cell_idx").distinct()
    weights = matrix.cell_embedding(cells, 4, 1).withColumnRenamed("vec", "w")
    conditions = cut_lineage(dataset.gene_conditions(samples.counts, weights, 3, 1))
    assert conditions.count() == 5
    blocks = cut_lineage(patch_vectors(samples.pixels, 8, 1))
    start = cut_lineage(fit_codebook(blocks, 6, seed=1))
    book, metrics = training.refine_codebook(blocks, start, 3, snapshots=str(tmp_path / "codec"))
    losses = [r["value"] for r in metrics.orderBy("step").collect()]
    assert len(losses) == 3 and all(math.isfinite(x) for x in losses)
    codec = generating.Codec(book, 6, 8, 1)
    tokens = cut_lineage(codec.encode(samples.pixels))
    assert tokens.count() == 5 * 16
    scorer, loss = training.train_scorer(tokens, conditions, 6, valid_frac=0.3)
    assert loss.first()[0] > 0
    image = codec.decode(generating.generate(conditions, scorer, generating.Decoding(4, 6, 2, timesteps=3, thres=0.5)))
    assert image.agg(F.max("px")).first()[0] <= 7


def test_refinement_resumes(spark, tmp_path):
    data = spark.range(200).select(F.array(*[uniform(i, "id") for i in range(3)]).alias("vec"))
    book = spark.range(4).select(F.col("id").cast("int").alias("code_id"), F.array(*[uniform(9 + i, "id") for i in range(3)]).alias("vec"))
    whole, _ = training.refine_codebook(data, book, 4)
    path = str(tmp_path / "state")
    training.refine_codebook(data, book, 2, snapshots=path)
    resumed, metrics = training.refine_codebook(data, book, 4, snapshots=path)
    assert saved_steps(spark, path) == [0, 1, 2, 3] and [r["step"] for r in metrics.orderBy("step").collect()] == [2, 3]
    for a, b in zip(rows(whole), rows(resumed)):
        assert a[0] == b[0] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[1], b[1]))


def made_up_images(spark, genes=24, size=8):
    return spark.createDataFrame(
        [(g, x, y, float(1 + (g * 7 + x * 3 + y) % 5) / 5) for g in range(genes) for x in range(size) for y in range(size) if (g + x * y) % 3],
        "gene_idx int, px int, py int, value float",
    )


def test_codec_flow_rates_its_hold_out_and_goes_on(spark, tmp_path):
    """Losses of accumulated batches by hand, pictures of hold-out images, and a run in two halves."""
    from spotgrid.operators import codebook, raster
    from spotgrid.plans.training import codebook_step, started, train_codec
    from spotgrid.sinks.snapshots import load_snapshot

    pixels = made_up_images(spark)
    genes = spark.range(26).selectExpr("cast(id as int) as gene_idx")  # two genes without a pixel
    start = codebook.fit_codebook(raster.patch_vectors(pixels, 8, 1), 6, seed=2, rounds=1)
    settings = dict(batch_size=5, grad_accum=2, valid_frac=0.25, seed=4, every=2)
    book, metrics = train_codec(pixels, genes, start, 8, 1, 5, results=str(tmp_path / "whole"), **settings)
    got = {(r["step"], r["key"]): (r["epoch"], r["value"]) for r in metrics.collect()}
    assert sorted(k for k in got if k[1] == "loss") == [(i, "loss") for i in range(5)]
    assert {s for s, k in got if k == "valid"} == {s for s, k in got if k == "valid_l1"} == {0, 2, 4}
    assert got[4, "valid"][1] <= got[0, "valid"][1] * 1.05 and [got[i, "loss"][0] for i in range(5)] == [1, 1, 2, 2, 3]
    half, _ = train_codec(pixels, genes, start, 8, 1, 3, results=str(tmp_path / "half"), **settings)
    resumed, later = train_codec(pixels, genes, start, 8, 1, 5, results=str(tmp_path / "half"), **settings)
    assert sorted({r["step"] for r in later.collect()}) == [3, 4]
    as_rows = lambda b: {r["code_id"]: [round(x, 9) for x in r["vec"]] for r in b.collect()}
    assert as_rows(resumed) == as_rows(book) != as_rows(half)
    picture = load_snapshot(spark, str(tmp_path / "whole/mosaic"), 4)
    assert picture.count() > 0 and picture.agg(F.max("value")).first()[0] <= 1.0 and picture.agg(F.max("mx")).first()[0] < 2 * 10 + 2
    # One accumulated step by hand: the mean over batches of their mean gaps.
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [0.0, 4.0]), (1, [3.0, 0.0])], "batch long, vec array<double>")
    codes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "code_id int, vec array<double>")
    state, found = codebook_step(started(codes), vectors, 0.5, by="batch")
    assert abs(found["loss"] - ((0 + 1 + 9) / 6 + 4 / 2) / 2) < 1e-12
    assert {r["code_id"]: (r["n"], list(r["total"])) for r in state.collect()} == {1: (1.5, [2.5, 0.0]), 2: (1.5, [0.0, 3.5])}
    nothing, found = codebook_step(started(codes), vectors.where("batch = 9"), 0.5, by="batch")
    assert found["loss"] is None and {r["n"] for r in nothing.collect()} == {0.5}


def test_scorer_flow_accumulates_batches(spark, tmp_path):
    """Two batches a step: epochs close at the step of their last batch; step losses are means of batch losses."""
    from spotgrid.operators import masking, sampling, scoring
    from spotgrid.plans.training import train_flow

    tokens = spark.range(40 * 9).selectExpr("id div 9 as sample_id", "cast(id % 9 as int) as pos", "cast((id * 5 + id div 9) % 4 as int) as token_id")
    conds = spark.range(40).selectExpr("id as sample_id", "id % 3 as cond")
    one, single = train_flow(tokens, conds, 4, 12, 6, str(tmp_path / "one"), valid_frac=0.25, seed=3)
    two, metrics = train_flow(tokens, conds, 4, 6, 6, str(tmp_path / "two"), valid_frac=0.25, seed=3, grad_accum=2, log_steps=True)
    assert rows(one.seen.select("cond", "pos", "token_id", "n")) == rows(two.seen.select("cond", "pos", "token_id", "n"))
    valid = {r["epoch"]: (r["step"], r["value"]) for r in metrics.where("key = 'valid'").collect()}
    before = {r["epoch"]: (r["step"], r["value"]) for r in single.collect()}
    assert {e: (s // 2, round(v, 9)) for e, (s, v) in before.items()} == {e: (s, round(v, 9)) for e, (s, v) in valid.items()} and len(valid) == 2
    steps = {r["step"]: r["value"] for r in metrics.where("key = 'train' and epoch = 2").collect()}
    split = sampling.exact_split(conds, "sample_id", 0.25, 3).where("split = 'train'").drop("split")
    plan = sampling.cycle_batches(split, "sample_id", 6, 6, 2, 3).where("epoch = 0").select("sample_id", "cond")
    first = scoring.fit_token_scorer(tokens, plan).saved()
    second = sampling.cycle_batches(split, "sample_id", 6, 6, 2, 3).where("epoch = 1").select("step", "batch_id", "sample_id", "cond")
    hidden = masking.mask_tokens(tokens.join(second.select("sample_id"), "sample_id", "left_semi"), 4, 3 + 1).where("masked").join(second, "sample_id")
    want = {}
    for r in second.select("step", "batch_id").distinct().collect():
        own = hidden.where((F.col("step") == r["step"]) & (F.col("batch_id") == r["batch_id"]))
        loss = first.cross_entropy(scoring.resolve_conditions(own, first), 4).first()[0]
        want[r["step"]] = want.get(r["step"], 0) + loss / 2
    assert {s: round(v, 9) for s, v in steps.items()} == {s: round(v, 9) for s, v in want.items()}


def test_two_stages_are_trained_from_files(spark, tmp_path):
    """Counts of the second stage by hand: low-resolution token and condition at each position; then both generate."""
    from spotgrid.operators.codebook import fit_codebook
    from spotgrid.operators.raster import patch_vectors, resize_nearest
    from spotgrid.plans.session import cut_lineage

    write_dataset(tmp_path, spots=90, genes=6)
    samples = dataset.read_samples(spark, str(tmp_path), 16)
    pixels = cut_lineage(samples.pixels)
    conditions = cut_lineage(spark.range(6).selectExpr("id as sample_id", "id % 2 as cond"))
    low_pixels = resize_nearest(pixels, 16, 8)
    codecs = [generating.Codec(cut_lineage(fit_codebook(patch_vectors(p, size, 1), 5, seed=1, rounds=2)), 5, size, 1) for p, size in ((low_pixels, 8), (pixels, 16))]
    base, superres, metrics = training.train_two_stage(pixels, conditions, 16, *codecs, steps=3, batch_size=2, results=str(tmp_path / "two"), valid_frac=0.2, seed=1)
    assert {r["key"] for r in metrics.collect()} == {"base/valid", "superres/valid"} and metrics.where("value is null or isnan(value)").count() == 0
    low = {(r["sample_id"], r["pos"]): r["token_id"] for r in codecs[0].encode(low_pixels, conditions).collect()}
    high = {(r["sample_id"], r["pos"]): r["token_id"] for r in codecs[1].encode(pixels, conditions).collect()}
    split = training.exact_split(conditions, "sample_id", 0.2, 1).where("split = 'train'").drop("split")
    plan = training.cycle_batches(split, "sample_id", 2, 3, 1, 1).select("sample_id", "cond").collect()
    want = {}
    for r in plan:
        for pos in range(64):
            row, col = divmod(pos, 8)
            key = (r["cond"] * 5 + low[r["sample_id"], (row // 2) * 4 + col // 2], pos, high[r["sample_id"], pos])
            want[key] = want.get(key, 0) + 1
    assert {(r["cond"], r["pos"], r["token_id"]): r["n"] for r in superres.seen.collect()} == want
    image = generating.generate_two_stage(conditions, base, codecs[0], superres, codecs[1], seed=3, timesteps=3, thres=0.5)
    assert image.count() > 0 and image.agg(F.max("px")).first()[0] <= 15
