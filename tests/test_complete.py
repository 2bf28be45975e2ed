"""Nothing is lost: blank genes, missing counts, headers of split files, open epochs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from spotgrid.functions.scalars import clamp
from spotgrid.operators import codebook, matrix, raster, tracking
from spotgrid.operators.mosaics import mosaic
from spotgrid.plans.dataset import gene_conditions, read_samples
from spotgrid.sources import files
from spotgrid.sources.checks import validate_dataset


@pytest.fixture
def three_genes(tmp_path):
    """Gene a is full, b has counts but no pixel, c has pixels but no count; one count is missing."""
    (tmp_path / files.INSITU_FILE).write_text("a\tb\tc\n1\t0\t4\n7\t0\t\n3\t0\t5\n2\t0\t6\n")
    (tmp_path / files.LOCATION_FILE).write_text("x\ty\n0\t0\n1\t0\n2\t3\n3\t3\n")
    (tmp_path / files.SCRNA_FILE).write_text(",c1,c2,c3,c4\na,1,0,2,0\nb,0,3,0,0\nc,0,0,0,0\n")
    return str(tmp_path)


def test_every_gene_has_a_sample(spark, three_genes):
    samples = read_samples(spark, three_genes, 4)
    got = {r["gene_idx"]: r for r in samples.arrays(4).collect()}
    assert sorted(got) == [0, 1, 2]
    assert [list(got[g]["counts"]) for g in (0, 1, 2)] == [[1, 0, 2, 0], [0, 3, 0, 0], [0] * 4]
    assert list(got[1]["image"]) == [0] * 16
    assert got[0]["image"][0] == 1 and got[0]["image"][4] == 7 and math.isnan(got[2]["image"][4])
    blocks = samples.count_blocks(4, 3).collect()
    assert sorted((r["gene_idx"], r["block"]) for r in blocks) == [(g, b) for g in range(3) for b in (0, 1)]


def test_every_sample_has_tokens_and_missing_counts_are_zero(spark, three_genes):
    samples = read_samples(spark, three_genes, 4)
    book = spark.createDataFrame([(0, [0.0] * 4), (1, [1.0, 0.0, 7.0, 0.0]), (2, [0.0, 5.0, 0.0, 6.0])], "code_id int, vec array<double>")
    ids = samples.genes.select(F.col("gene_idx").cast("long").alias("sample_id"))
    tokens = codebook.tokenize(samples.pixels, book, 4, 1, ids)
    assert tokens.count() == 12 and tokens.where("token_id < 0").count() == 0
    assert {r["token_id"] for r in tokens.where("sample_id = 1").collect()} == {0}
    broken = spark.createDataFrame([(0, [float("nan"), 5.0, None, 6.0])], "gene_idx int, vec array<double>")
    assert codebook.assign_codes(broken, book).first()["code_id"] == 2
    sums = codebook.code_sums(broken.select(F.lit(1).alias("code_id"), "vec")).first()
    assert list(sums["total"]) == [0, 5, 0, 6]


def test_every_gene_has_a_condition(spark):
    counts = spark.createDataFrame([(g, c, float(1 + (g * c) % 5)) for g in range(6) for c in range(4)], "gene_idx int, cell_idx int, count float")
    weights = spark.createDataFrame([(c, [float(c), 1.0 - c]) for c in range(4)], "cell_idx int, w array<double>")
    genes = spark.range(8).select(F.col("id").cast("int").alias("gene_idx"))
    found = {r["sample_id"]: r["cond"] for r in gene_conditions(counts, weights, 3, 1, genes).collect()}
    assert sorted(found) == list(range(8)) and found[6] == found[7] == 0


def test_context_mask_of_every_gene(spark):
    counts = spark.createDataFrame([(0, 1, 2.0), (1, 0, 0.0)], "gene_idx int, cell_idx int, count float")
    emb = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 2.0])], "cell_idx int, vec array<double>")
    genes = spark.createDataFrame([(0,), (1,), (2,)], "gene_idx int")
    got = {(r["gene_idx"], r["channel"]): r["usable"] for r in matrix.dense_context_mask(counts, emb, genes, 2).collect()}
    assert got == {(g, c): (c == 1 or (c == 2 and g == 0)) for g in range(3) for c in range(3)}


def test_pairing_by_name(spark, three_genes):
    samples = read_samples(spark, three_genes, 4)
    swapped = samples.scrna_genes.withColumn("gene", F.when(F.col("gene") == "a", "b").when(F.col("gene") == "b", "a").otherwise(F.col("gene")))
    from dataclasses import replace

    named = replace(samples, scrna_genes=swapped).by_name()
    assert {r["gene_idx"]: list(r["counts"]) for r in named.arrays(4).collect()} == {0: [0, 3, 0, 0], 1: [1, 0, 2, 0], 2: [0] * 4}
    with pytest.raises(ValueError):
        named.by_name()


def test_checks_see_rows_without_counts(spark, three_genes):
    data = files.load_dataset(spark, three_genes)
    check = lambda: validate_dataset(data.spots, data.count_rows, data.genes, data.scrna_genes, data.cells, 4, 1, codebook_size=4)
    assert check().count() == 0
    assert matrix.num_cells(data.cells).first()[0] == 4 and matrix.num_genes(data.genes).first()[0] == 3
    (open(f"{three_genes}/{files.LOCATION_FILE}", "a")).write("9\t9\n")
    data = files.load_dataset(spark, three_genes)
    assert [r["check"] for r in check().collect()] == ["spots"]


def test_lines_of_many_small_splits(spark, tmp_path):
    """Several files, each in many splits: numbers and headers hold, and no line is shuffled."""
    folder = tmp_path / "wide"
    folder.mkdir()
    names = "\t".join(f"g{i}" for i in range(40))
    table = np.arange(3 * 900 * 40).reshape(3, 900, 40) % 97
    for i, part in enumerate(table):
        (folder / f"part-{i}.tsv").write_text(names + "\n" + "\n".join("\t".join(map(str, row)) for row in part) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        counts, genes = files.read_wide_counts(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 3
        assert [r["gene"] for r in genes.orderBy("gene_idx").collect()] == names.split("\t")
        assert files.header_width(spark, str(folder), "\t").first()["width"] == 40
        got = np.zeros((2700, 40), dtype=int)
        for r in counts.collect():
            got[r["spot_id"], r["gene_idx"]] = r["value"]
        assert (got == table.reshape(2700, 40)).all()
        text = counts._jdf.queryExecution().toString()
        final = text[text.index("== Physical Plan ==") :]
        assert not re.search(r"Scan ExistingRDD\[\w+#\w+,", final)  # only the header is a driver-made row
        assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final
        assert not re.search(r"Exchange hashpartitioning\([^)]*value", final)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_clamp_and_mosaic_keep_missing_values(spark):
    got = spark.range(1).select(clamp(F.lit(float("nan")), 0, 1).alias("n"), clamp(F.lit(9.0), 0, 1).alias("h")).first()
    assert math.isnan(got["n"]) and got["h"] == 1
    pixel = "gene_idx int, px int, py int, value double"
    picture = mosaic(spark.createDataFrame([(3, 0, 0, float("nan")), (70000, 0, 0, 0.5)], pixel), spark.createDataFrame([(3, 1, 1, 0.25)], pixel), 2)
    found = {(r["my"], r["mx"]): r["value"] for r in picture.collect()}
    assert math.isnan(found.pop((2, 2))) and found == {(3, 7): 0.25, (6, 2): 0.5}


def test_open_epochs_are_not_reported(spark):
    losses = spark.createDataFrame([(i, float(i)) for i in range(11)], "step long, value double")
    assert rows(tracking.epoch_validation(losses, 1, 4)) == [(1, 3, 1.5), (2, 7, 5.5)]


def test_blank_images(spark):
    pixels = spark.createDataFrame([(1, 0, 1, 2.0)], "gene_idx int, px int, py int, value float")
    genes = spark.createDataFrame([(0,), (1,)], "gene_idx int")
    got = {r["gene_idx"]: list(r["image"]) for r in raster.dense_images(pixels, 2, genes=genes).collect()}
    assert got == {0: [0] * 4, 1: [0, 2, 0, 0]}
