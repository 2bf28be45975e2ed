import re

import pytest

from spotgrid.operators import codebook, decoding, generating, masking, matrix, raster, sampling, scoring


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """Tables read from files, so that plans show scans; joins may not broadcast by size."""
    folder = str(tmp_path_factory.mktemp("plans"))
    spark.range(100).selectExpr("id as spot_id", "cast(id as double) as x", "cast(id as double) as y", "'n' as note").write.parquet(f"{folder}/spots")
    spark.range(500).selectExpr("id % 100 as spot_id", "cast(id div 100 as int) as gene_idx", "cast(1 as float) as value", "'n' as note").write.parquet(f"{folder}/counts")
    spark.range(500).selectExpr("id div 16 as sample_id", "cast(id % 16 as int) as pos", "cast(id % 7 as int) as token_id").write.parquet(f"{folder}/tokens")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: spark.read.parquet(f"{folder}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_raster_never_shuffles_counts(big):
    text = plan(raster.rasterize(big("spots"), big("counts"), 16))
    assert exchanges(text) == 1 and "BroadcastHashJoin" in text
    assert "note" not in text, "unused columns are not read"


def test_raster_of_a_huge_grid_shuffles_instead(big):
    text = plan(raster.rasterize(big("spots"), big("counts"), 1 << 14))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_only_one_row_tables_are_nested_loop_joined(big):
    text = plan(raster.rasterize(big("spots"), big("counts"), 16))
    assert text.count("BroadcastNestedLoopJoin") == 1 and "CartesianProduct" not in text


def test_split_has_no_one_task_sort_of_rows(big, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 10)  # as a table of many buckets
    text = plan(sampling.exact_split(big("spots").select("spot_id"), "spot_id"))
    single = text.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate" in single[1], "only bucket counts meet in one task"


def test_masking_sorts_and_shuffles_once(big):
    text = plan(masking.mask_tokens(big("tokens"), 7, 1))
    assert exchanges(text) == 1 and len(re.findall(r"- Sort ", text)) == 1


def test_topk_filters_before_the_shuffle(big):
    logits = big("tokens").selectExpr("sample_id", "pos", "token_id", "cast(token_id as double) as logit")
    text = plan(decoding.topk_filter(logits, 7))
    assert text.count("WindowGroupLimit") == 2 and exchanges(text) == 1


def test_fused_prediction_shuffles_once(big):
    logits = big("tokens").selectExpr("sample_id", "pos", "token_id", "cast(token_id as double) as logit")
    assert exchanges(plan(decoding.predict(logits, 7, 0.5, 1.0, 1))) == 1


def test_codebook_join_is_broadcast_only_when_proven_small(spark, big):
    book = spark.range(7).selectExpr("cast(id as int) as code_id", "array(1.0D) as vec")
    assert "BroadcastHashJoin" in plan(codebook.decode_from_ids(big("tokens"), book, 7, 1))
    assert "BroadcastHashJoin" not in plan(codebook.decode_from_ids(big("tokens"), book))
    assert "BroadcastHashJoin" not in plan(codebook.decode_from_ids(big("tokens"), book, 1 << 24, 256))


def test_decoding_steps_form_one_stage(big):
    tokens = big("tokens")
    scorer = scoring.fit_token_scorer(tokens, tokens.selectExpr("sample_id", "sample_id % 2 as cond").distinct())
    samples = tokens.selectExpr("sample_id", "sample_id % 2 as cond").distinct()
    got = generating.generate(samples, scorer, generating.Decoding(4, 7, 1, timesteps=4, cut_every=9))
    text = plan(got)
    assert exchanges(text) <= 1 and "SortMergeJoin" not in text and text.count("Window [") == 4


def test_snapshot_reads_one_step(spark, tmp_path):
    from spotgrid.sinks.snapshots import load_snapshot, write_snapshot

    for step in (0, 1):
        write_snapshot(spark.range(10), str(tmp_path), step)
    latest = load_snapshot(spark, str(tmp_path), 1).where("id = 3")
    assert latest.inputFiles() and all("/step=1/" in name for name in latest.inputFiles())
    assert "EqualTo(id,3)" in plan(latest)


def test_projection_is_reduced_before_the_final_shuffle(spark, big):
    counts = big("counts").selectExpr("gene_idx", "cast(spot_id as int) as cell_idx", "value as count")
    weights = spark.range(100).selectExpr("cast(id as int) as cell_idx", "array(1.0D, 2.0D) as w")
    text = plan(matrix.project_counts(counts, weights))
    assert "MapInArrow" in text and "SortMergeJoin" not in text
