"""Numbered lines in byte ranges against plain reading."""

import gzip
import random

import pytest

from spotgrid.sources import files, lines


def plain(texts):
    """``(file_no, line, total_line, value)`` of files in order of their names."""
    out, total, number = [], 0, 0
    for text in texts:
        found = [x for x in text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip(" \t\x0b\f")]
        out += [(number, i, total + i, x) for i, x in enumerate(found)]
        total += len(found)
        number += bool(found)
    return out


def made_up(draw, size):
    parts = ["", "a", "word\t1", " ", "größer", "x" * 40, "1\t2\t3", "\x0b"]
    return "".join(draw.choice(parts) + draw.choice(["\n", "\n", "\r\n", "\r", "\n\n"]) for _ in range(size)) + draw.choice(["", "last"])


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 7, 64, 1000])
def test_ranges_hold_every_line_once(tmp_path, range_bytes):
    draw = random.Random(range_bytes)
    for i in range(25):
        text = made_up(draw, draw.randint(0, 40))
        path = tmp_path / f"{i}.txt"
        path.write_bytes(text.encode())
        got = [x.decode() for part in lines.ranges_of([path.as_uri()], range_bytes) for x in lines.lines_of(part)]
        assert got == [v for *_, v in plain([text])]


def test_mark_and_compressed_files(tmp_path, monkeypatch):
    text = "﻿one\r\ntwo\rthree\n\n four"
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(text.encode()))
    for chunk in (1, 2, 3, 1 << 20):
        monkeypatch.setattr(lines, "CHUNK_BYTES", chunk)
        for name in ("a.txt", "b.txt.gz"):
            assert [x.decode() for part in lines.ranges_of([(tmp_path / name).as_uri()], 5) for x in lines.lines_of(part)] == ["one", "two", "three", " four"]


@pytest.mark.parametrize("way", ["ranges", "spark"])
def test_numbers_over_files_and_ranges(spark, tmp_path, monkeypatch, way):
    """Several files and ranges, one file without lines; the session's settings stay as they are."""
    draw = random.Random(4)
    texts = [made_up(draw, 60), "\n \n", made_up(draw, 90), ""]
    for i, text in enumerate(texts):
        (tmp_path / f"part {i}.txt").write_bytes(text.encode())
    before = dict(spark.conf.getAll)
    if way == "spark":
        monkeypatch.setattr(lines, "reachable", lambda uris: False)
    got = lines.numbered_lines(spark, str(tmp_path), 50)
    assert sorted((r["file_no"], r["line"], r["total_line"], r["value"]) for r in got.collect()) == plain(texts)
    assert dict(spark.conf.getAll) == before


def test_no_job_before_the_result_is_read(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tb\n" + "\n".join(f"{i}\t{2 * i}" for i in range(1, 2000)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "")
    try:
        found = lines.numbered_lines(spark, str(tmp_path / "c.tsv"), 1000)
        assert not tracker.getJobIdsForGroup("lazy")
        assert found.count() == 2000
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    counts, genes = files.read_wide_counts(spark, str(tmp_path / "c.tsv"))
    assert genes.count() == 2 and counts.count() == 2 * 1999
