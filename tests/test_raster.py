import math

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spotgrid.operators import raster
from spotgrid.operators.mosaics import mosaic

SPOTS = [(0, 0.0, 0.0), (1, 10.0, 20.0), (2, 5.0, 10.0), (3, 10.0, 20.0)]
COUNTS = [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 7.0), (1, 1, 8.0), (2, 0, 3.0), (2, 1, None), (3, 0, 2.0), (3, 1, 0.0)]
PIXELS = "gene_idx int, px int, py int, value float"


def spots(spark, data=SPOTS):
    return spark.createDataFrame(data, "spot_id long, x double, y double")


def pixels(spark, data):
    return spark.createDataFrame(data, PIXELS)


@pytest.mark.parametrize("size_limit", [1 << 40, 0])
def test_rasterize_last_spot_wins(spark, monkeypatch, size_limit):
    import spotgrid.plans.sizing as sizing

    monkeypatch.setattr(raster, "bounded", lambda df, r, b: sizing.bounded(df, r, b, size_limit))
    counts = spark.createDataFrame(COUNTS, "spot_id long, gene_idx int, value float")
    got = rows(raster.rasterize(spots(spark), counts, 11))
    assert [r[:3] for r in got] == [(0, 0, 0), (0, 5, 5), (0, 10, 10), (1, 5, 5)]
    assert [r[3] for r in got[:3]] == [1.0, 3.0, 2.0] and math.isnan(got[3][3])


def test_rasterize_ignores_order(spark):
    counts = spark.createDataFrame(COUNTS, "spot_id long, gene_idx int, value float")
    a = raster.rasterize(spots(spark), counts, 11).where("not isnan(value)")
    b = raster.rasterize(spots(spark, SPOTS[::-1]).repartition(5), counts.repartition(7), 11).where("not isnan(value)")
    assert rows(a) == rows(b)


def test_truncation(spark):
    data = [(0, 0.0, 0.0), (1, 2.7, 1.0), (2, 10.0, 10.0)]
    got = raster.scale_coordinates(spots(spark, data), 11).select("px")
    assert rows(got) == [(0,), (2,), (10,)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_zero_range_raises(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="coordinates are equal"):
            raster.scale_coordinates(spots(spark, [(0, 1.0, 0.0), (1, 1.0, 2.0)]), 4).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_points_keep_missing_and_drop_zero(spark):
    data = [("a", 0, 0.0, 0.0, 5.0), ("a", 1, 0.0, 0.0, None), ("a", 2, 1.0, 1.0, 4.0), ("a", 3, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(data, "gene string, ord long, x double, y double, value double")
    got = rows(raster.rasterize_points(df, 2))
    assert len(got) == 1 and got[0][:3] == ("a", 0, 0) and math.isnan(got[0][3])


@pytest.mark.parametrize("n_in,n_out,sources", [(4, 2, [0, 2]), (2, 4, [0, 0, 1, 1]), (3, 2, [0, 1]), (5, 5, [0, 1, 2, 3, 4])])
def test_resize(spark, n_in, n_out, sources):
    data = [(0, i, j, float(10 * i + j + 1)) for i in range(n_in) for j in range(n_in)]
    got = {(r[1], r[2]): r[3] for r in rows(raster.resize_nearest(pixels(spark, data), n_in, n_out))}
    assert got == {(o, q): float(10 * sources[o] + sources[q] + 1) for o in range(n_out) for q in range(n_out)}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(0, 2), st.integers(0, 7), st.integers(0, 7)), st.integers(1, 9), min_size=1, max_size=40))
def test_dense_and_patches_round_trip(spark, cells):
    data = [(g, x, y, float(v)) for (g, x, y), v in cells.items()]
    df = pixels(spark, data)
    assert rows(raster.sparse_pixels(raster.dense_images(df, 8), 8)) == sorted(data)
    assert rows(raster.unpatch(raster.patch_vectors(df, 8, 2), 2)) == sorted(data)


def test_patch_size_must_divide(spark):
    with pytest.raises(ValueError):
        raster.patch_vectors(pixels(spark, [(0, 0, 0, 1.0)]), 18, 2)


def test_paired_by_name(spark):
    counts = spark.createDataFrame([(0, 0, 5.0), (1, 0, 6.0)], "gene_idx int, cell_idx int, count float")
    insitu = spark.createDataFrame([(0, "b"), (1, "a")], "gene_idx int, gene string")
    scrna = spark.createDataFrame([(0, "a"), (1, "b")], "gene_idx int, gene string")
    by_index = rows(raster.paired_samples(counts, pixels(spark, []), insitu))
    by_name = rows(raster.paired_samples(counts, pixels(spark, []), insitu, scrna))
    assert [r[-1] for r in by_index] == [5.0, 6.0] and [r[-1] for r in by_name] == [6.0, 5.0]


def test_paired_arrays(spark):
    from spotgrid.operators.matrix import gene_vectors

    counts = spark.createDataFrame([(0, 2, 5.0)], "gene_idx int, cell_idx int, count float")
    images = raster.dense_images(pixels(spark, [(0, 1, 0, 2.0)]), 2)
    got = raster.paired_arrays(gene_vectors(counts, 3), images).first()
    assert list(got["counts"]) == [0, 0, 5] and list(got["image"]) == [0, 0, 2, 0]


def test_mosaic_layout(spark):
    a = pixels(spark, [(0, 0, 0, 0.5), (1, 1, 1, 3.0), (1, 0, 0, -1.0)])
    b = pixels(spark, [(0, 0, 0, 0.25)])
    assert rows(mosaic(a, b, 2)) == [(2, 2, 0.5), (2, 6, 0.25), (7, 3, 1.0)]
