"""Snapshots that crash, retention, workspaces, and checks without a pass of their own."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spotgrid.catalog import QUERIES
from spotgrid.plans import session
from spotgrid.sinks import snapshots
from spotgrid.sources import checks

FOLDER = "/root/testdata/sf0.001"


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_a_step_written_again_replaces_the_earlier_one_when_complete(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    for step in (0, 1, 2):
        snapshots.write_snapshot(spark.range(step + 1), path, step)
    before = files_below(path)

    def crash(*args):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "_write_manifest", crash)
        with pytest.raises(OSError):
            snapshots.write_snapshot(spark.range(50), path, 1)
        with pytest.raises(OSError):
            snapshots.write_snapshot(spark.range(60), path, 3)
    assert snapshots.saved_steps(spark, path) == [0, 1, 2]
    assert snapshots.load_snapshot(spark, path, 1).count() == 2 and snapshots.load_snapshot(spark, path).count() == 3
    assert snapshots.tidy(spark, path) == 2 and [f for f in files_below(path) if "manifest" not in f] == [f for f in before if "manifest" not in f]
    snapshots.write_snapshot(spark.range(7), path, 1)
    snapshots.write_snapshot(spark.range(9), path, 3)
    assert snapshots.load_snapshot(spark, path, 1).count() == 7 and snapshots.load_snapshot(spark, path).count() == 9
    assert snapshots.tidy(spark, path) == 0


def test_a_snapshot_that_failed_while_writing_does_not_show(spark, tmp_path):
    path = str(tmp_path)
    snapshots.write_snapshot(spark.range(3), path, 0)
    bad = spark.range(10).withColumn("x", F.raise_error(F.lit("bad row")).cast("int"))
    with pytest.raises(Exception, match="bad row"):
        snapshots.write_snapshot(bad, path, 1)
    assert snapshots.latest_step(spark, path) == 0
    assert snapshots.tidy(spark, path) <= 1
    assert not [x for x in os.listdir(path) if x.startswith("_step")]


def test_the_last_snapshots_stay(spark, tmp_path):
    path = str(tmp_path)
    for step in range(6):
        snapshots.write_snapshot(spark.range(step + 1), path, step, keep=2)
    assert snapshots.saved_steps(spark, path) == [4, 5]
    assert sorted(x for x in os.listdir(path) if x.startswith("step")) == ["step=4", "step=5"]
    with pytest.raises(ValueError):
        snapshots.write_snapshot(spark.range(1), path, 6, keep=0)


def test_a_workspace_leaves_nothing_but_the_result(spark, tmp_path):
    held = spark.sparkContext.getCheckpointDir()
    with session.workspace(spark) as folder:
        result = QUERIES["generate"](spark, FOLDER)
        result.write.parquet(str(tmp_path / "out"))
        assert files_below(folder.removeprefix("file:"))
        with session.workspace(spark) as inner:
            session.cut_lineage(spark.range(5))
            assert inner.startswith(folder) and files_below(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:"))
        assert session.cut_lineage(spark.range(5)).count() == 5
    assert not os.path.exists(folder.removeprefix("file:"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert session.shared_root(spark) == session.shared_root(spark) and (held is None or spark.sparkContext.getCheckpointDir())


def made_up(spark):
    return {
        "spots": spark.range(5),
        "count_rows": spark.range(6),
        "genes": spark.range(9),
        "gene_rows": spark.range(8),
        "cells": spark.range(4),
        "pixels": spark.createDataFrame([(0, 7), (8, 1)], "px int, py int"),
        "tokens": spark.createDataFrame([(3,), (9,)], "pos int"),
    }


SETTINGS = dict(image_size=7, layers=1, codebook_size=5, seq_len=8, has_embeddings=True, superres=True)


def test_one_aggregate_per_table(spark):
    tables = made_up(spark)
    found = checks.validate_dataset(tables["spots"], tables["count_rows"], tables["genes"], tables["gene_rows"], tables["cells"], pixels=tables["pixels"], tokens=tables["tokens"], **SETTINGS)
    assert [r["check"] for r in found.collect()] == ["spots", "genes", "divisible", "inputs", "condition", "sequence", "codebook", "image", "tokens"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 7
    fine = checks.validate_dataset(spark.range(5), spark.range(5), spark.range(3), spark.range(3), spark.range(4), 8, 1)
    assert fine.count() == 0


def test_watched_tables_are_checked_by_the_job_that_reads_them(spark):
    tables = made_up(spark)
    watch = checks.Watch()
    read = {name: watch.of(name, df).agg(F.count(F.lit(1))).first()[0] for name, df in tables.items()}
    assert read["genes"] == 9
    direct = checks.validate_dataset(tables["spots"], tables["count_rows"], tables["genes"], tables["gene_rows"], tables["cells"], pixels=tables["pixels"], tokens=tables["tokens"], **SETTINGS)
    assert rows(watch.violations(spark, **SETTINGS)) == rows(direct)
    some = checks.Watch()
    some.of("spots", spark.range(3)).count()
    assert rows(some.violations(spark, 8, 1)) == []
    with pytest.raises(ValueError):
        some.of("lines", spark.range(1))
