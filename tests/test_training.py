import math
import random

import pytest
from conftest import rows

from spotgrid.operators import losses, tracking
from spotgrid.sinks import snapshots


def test_hinge_and_gen(spark):
    pairs = spark.createDataFrame([(0.5, 2.0), (-2.0, 0.5)], "fake double, real double")
    assert losses.hinge_discr(pairs).first()[0] == 1.0
    assert losses.hinge_gen(pairs).first()[0] == 0.75


def test_cross_entropy(spark):
    logits = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 0.0), (0, 1, 0, 3.0)], "sample_id long, pos int, token_id int, logit double")
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, -1)], "sample_id long, pos int, label int")
    assert math.isclose(losses.masked_cross_entropy(logits, labels).first()[0], math.log(2))
    unseen = spark.createDataFrame([(0, 0, 5)], "sample_id long, pos int, label int")
    assert losses.masked_cross_entropy(logits, unseen).first()[0] == math.inf


def test_recon_loss_is_dense(spark):
    layout = "gene_idx int, px int, py int, value float"
    a = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 1, 1.0)], layout)
    b = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 3.0)], layout)
    assert losses.recon_loss(a, b, 4).first()[0] == (1.5 + 1 + 3) / 4
    assert losses.recon_loss(a, b, 4, "l2").first()[0] == (2.25 + 1 + 9) / 4
    assert losses.recon_loss(a, a, 4).first()[0] == 0.0


def ema_by_hand(steps, beta, after, every):
    value, out = None, {}
    for step, x in sorted(steps):
        if step % every == 0:
            value = x if value is None or step <= after else beta * value + (1 - beta) * x
        out[step] = value
    return out


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("after,every", [(0, 1), (10, 3), (1000, 1)])
def test_ema_by_hand(spark, block, after, every):
    rnd = random.Random(5)
    data = [(k, s, rnd.uniform(-1, 1)) for k in "ab" for s in range(60) if rnd.random() < 0.8]
    df = spark.createDataFrame(data, "key string, step long, value double").repartition(4)
    got = {(r["key"], r["step"]): r["ema"] for r in tracking.ema_by_key(df, "key", "step", "value", 0.9, after, every, block).collect()}
    assert len(got) == len(data)
    for k in "ab":
        for step, want in ema_by_hand([(s, v) for kk, s, v in data if kk == k], 0.9, after, every).items():
            assert (got[k, step] is None) == (want is None)
            assert want is None or math.isclose(got[k, step], want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("unit", ["samples", "batches"])
def test_epochs_follow_the_counter(spark, unit):
    batch_size, batches = 4, 10
    counter, epoch, closing = 0, 1, []
    for step in range(40):
        counter += batch_size if unit == "samples" else 1
        if counter >= batches:
            closing.append((epoch, step))
            counter, epoch = 0, epoch + 1
    df = spark.createDataFrame([(s, float(s)) for s in range(40)], "step long, value double")
    got = rows(tracking.epoch_validation(df, batch_size, batches, unit))
    assert [r[:2] for r in got][: len(closing)] == closing
    period = tracking.epoch_length(batch_size, batches, unit)
    assert got[0][2] == sum(range(period)) / period


def test_accumulate(spark):
    df = spark.createDataFrame([(0, "loss", 2.0), (0, "loss", 4.0), (1, "loss", 8.0)], "step long, key string, value double")
    assert rows(tracking.accumulate_metrics(df, 2)) == [(0, "loss", 3.0), (1, "loss", 4.0)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    for step in range(5):
        wrote = snapshots.write_snapshot(spark.range(step + 1), path, step, every=2)
        assert wrote == (step % 2 == 0)
    assert snapshots.saved_steps(spark, path) == [0, 2, 4]
    assert snapshots.load_snapshot(spark, path).count() == 5
    assert snapshots.load_snapshot(spark, path, 2).count() == 3
    for missing in (1, 9):
        with pytest.raises(FileNotFoundError):
            snapshots.load_snapshot(spark, path, missing)
    with pytest.raises(FileNotFoundError):
        snapshots.load_snapshot(spark, str(tmp_path / "none"))


def test_prepare_results(spark, tmp_path):
    path = str(tmp_path / "results")
    snapshots.prepare_results(spark, path)
    snapshots.write_snapshot(spark.range(1), path, 0)
    with pytest.raises(FileExistsError):
        snapshots.prepare_results(spark, path)
    snapshots.prepare_results(spark, path, clear=True)
    assert snapshots.saved_steps(spark, path) == []


def test_replayed_micro_batch_counts_once(spark, tmp_path):
    from spotgrid.streaming import partials

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = spark.createDataFrame([(0, "loss", 2.0), (0, "loss", 4.0)], "step long, key string, value double")
    data.write.parquet(source)
    for log in ("a", "b"):  # a lost log replays batch 0 into the same directory
        stream = spark.readStream.schema(data.schema).parquet(source)
        partials.write_partials(stream, partials.reduce_metrics(2), out, str(tmp_path / log)).awaitTermination()
    assert rows(partials.merged_metrics(spark, out).select("step", "key", "value")) == [(0, "loss", 3.0)]
