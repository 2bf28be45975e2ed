import pytest
from conftest import rows

from spotgrid.sources import files


def save(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_wide_counts(spark, tmp_path):
    path = save(tmp_path, "c.tsv", "g1\tg1\tg2\n1\t\t0\n\n4\t5\n")
    counts, genes = files.read_wide_counts(spark, path)
    assert rows(genes) == [(0, "g1"), (1, "g1"), (2, "g2")]
    got = {(r[0], r[1]): r[2] for r in counts.collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (1, 0): 4.0, (1, 1): 5.0, (1, 2): None}
    kept, _ = files.read_wide_counts(spark, path, keep_zeros=True)
    assert kept.where("value = 0").count() == 1


def test_bad_number_raises(spark, tmp_path):
    counts, _ = files.read_wide_counts(spark, save(tmp_path, "c.tsv", "g\nx1\n"))
    with pytest.raises(Exception):
        counts.collect()


def test_row_numbers_over_splits_and_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        folder = tmp_path / "many"
        folder.mkdir()
        body = [f"{i}\t{i * 2}" for i in range(1, 401)]
        save(folder, "part-0.tsv", "a\tb\n" + "\n".join(body[:300]) + "\n")
        save(folder, "part-1.tsv", "a\tb\n" + "\n\n".join(body[300:]))
        counts, _ = files.read_wide_counts(spark, str(folder))
        got = {(r[0], r[1]): r[2] for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(i, g): float((i + 1) * (g + 1)) for i in range(400) for g in range(2)}


def test_wide_file(spark, tmp_path):
    width = 30000
    header = "\t".join(f"g{i}" for i in range(width))
    lines = ["\t".join(str(r * 7 + i % 5) for i in range(width)) for r in range(3)]
    counts, genes = files.read_wide_counts(spark, save(tmp_path, "w.tsv", "\n".join([header, *lines])), keep_zeros=True)
    assert genes.count() == width and counts.count() == 3 * width
    assert counts.where("value != spot_id * 7 + gene_idx % 5").count() == 0


def test_count_matrix_with_quotes(spark, tmp_path):
    text = '"","c,1","c""2"\n"G,1",1,2\nG2,0,3\n'
    counts, genes, cells = files.read_count_matrix(spark, save(tmp_path, "m.csv", text))
    assert rows(genes) == [(0, "G,1"), (1, "G2")]
    assert rows(cells) == [(0, "c,1"), (1, 'c"2')]
    assert rows(counts) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)]


def test_header_only_reads(spark, tmp_path):
    path = save(tmp_path, "m.csv", ",c1,c2\nG,1,2\n")
    assert files.header_width(spark, path, ",", 1).first()["width"] == 2
    tsv = save(tmp_path, "c.tsv", "a\tb\n1\t2\n")
    assert rows(files.gene_index(spark, tsv)) == [(0, "a"), (1, "b")]


def test_locations(spark, tmp_path):
    path = save(tmp_path, "l.tsv", "first\tsecond\textra\n1.5\t2\tz\n3\t4\tz\n")
    assert rows(files.read_locations(spark, path)) == [(0, 1.5, 2.0), (1, 3.0, 4.0)]
    for bad in ("x\ty\n1\t\n", "x\ty\n1\tq\n", "x\ty\n1\n"):
        with pytest.raises(Exception):
            files.read_locations(spark, save(tmp_path, "bad.tsv", bad)).collect()


@pytest.mark.parametrize("slash", ["", "/"])
def test_load_dataset(spark, tmp_path, slash):
    save(tmp_path, files.INSITU_FILE, "g1\tg2\n1\t0\n7\t8\n3\t\n2\t0\n")
    save(tmp_path, files.LOCATION_FILE, "x\ty\n0\t0\n10\t20\n5\t10\n10\t20\n")
    save(tmp_path, files.SCRNA_FILE, ",c1,c2\ng1,1,0\ng2,4,5\n")
    data = files.load_dataset(spark, str(tmp_path) + slash)
    from spotgrid.operators.raster import rasterize

    got = rasterize(data.spots, data.insitu, 11).where("not isnan(value)")
    assert rows(got) == [(0, 0, 0, 1.0), (0, 5, 5, 3.0), (0, 10, 10, 2.0)]
    assert rows(data.scrna) == [(0, 0, 1.0), (1, 0, 4.0), (1, 1, 5.0)]


def test_checks(spark):
    from spotgrid.sources.checks import validate_dataset

    spots = spark.createDataFrame([(i, 0.0, 0.0) for i in range(4)], "spot_id long, x double, y double")
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "gene_idx int, gene string")
    cells = spark.range(4)
    found = validate_dataset(
        spots, spark.range(2), genes, genes.limit(2), cells, 16, 2, codebook_size=5, has_embeddings=True, superres=True, seq_len=16
    )
    assert [r[0] for r in rows(found)] == ["codebook", "condition", "genes", "inputs", "spots"]
    fine = validate_dataset(spots, spark.range(4), genes, genes, cells, 16, 2, codebook_size=4)
    assert fine.count() == 0
