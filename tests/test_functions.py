import math

from conftest import rows
from pyspark.sql import functions as F

from spotgrid.functions import arrays, keyed, scalars
from spotgrid.operators.decoding import kept_logits
from spotgrid.operators.masking import schedule_steps


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_keyed_uniform_value(spark):
    assert one(spark, keyed.uniform(3407, F.lit(7))) == 0.9524352105800062


def test_uniform_ignores_partitioning(spark):
    df = spark.range(1000).select("id", keyed.uniform(1, "id").alias("u"))
    again = spark.range(1000).repartition(7).select("id", keyed.uniform(1, "id").alias("u"))
    assert rows(df) == rows(again)
    values = [u for _, u in rows(df)]
    assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / 1000 - 0.5) < 0.05


def test_prob_mask_ends(spark):
    assert one(spark, keyed.prob_mask(1, 0, F.lit(3))) is True
    assert one(spark, keyed.prob_mask(0, 0, F.lit(3))) is False


def test_gumbel_is_finite_at_the_ends(spark):
    for u in (0.0, 0.5, 1 - 2**-32):
        assert math.isfinite(one(spark, keyed.gumbel_noise(F.lit(u))))


def test_layer_norm_and_l2(spark):
    vec = F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 6.0)])
    got = one(spark, arrays.layer_norm(vec))
    var = (4 + 1 + 0 + 9) / 4
    assert all(math.isclose(g, (x - 3) / math.sqrt(var + 1e-5)) for g, x in zip(got, (1, 2, 3, 6)))
    flat = F.array(F.lit(2.0), F.lit(2.0))
    assert one(spark, arrays.layer_norm(flat, mode="clamp")) == [0.0, 0.0]
    assert one(spark, arrays.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, arrays.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_fill_gaps(spark):
    entries = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(v).alias("item")) for p, v in ((3, 7.0), (1, 5.0))])
    assert one(spark, arrays.fill_gaps(entries, 5, F.lit(0.0))) == [0.0, 5.0, 0.0, 7.0, 0.0]
    empty = F.array().cast("array<struct<pos:int,item:double>>")
    assert one(spark, arrays.fill_gaps(empty, 2, F.lit(0.0))) == [0.0, 0.0]


def test_fill_gaps_refuses_repeats_and_overflow(spark):
    import pytest

    twice = F.array(*[F.struct(F.lit(1).alias("pos"), F.lit(v).alias("item")) for v in (1.0, 2.0)])
    for size, entries in ((5, twice), (1, twice)):
        with pytest.raises(Exception, match="repeated or out of range"):
            one(spark, arrays.fill_gaps(entries, size, F.lit(0.0)))


def test_clamp_keeps_null(spark):
    assert one(spark, scalars.clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, scalars.clamp(F.lit(3.0), 0, 1)) == 1.0


def test_grid_side():
    import pytest

    assert scalars.grid_side(512, 4) == 32
    with pytest.raises(ValueError):
        scalars.grid_side(18, 2)


def test_kept_logits():
    assert [kept_logits(v) for v in (4, 10, 64, 100, 512, 14249)] == [1, 1, 7, 10, 52, 1425]


def test_schedule():
    steps = schedule_steps(16, 4)
    assert [s.hidden for s in steps] == [16, 13, 8, 1]
    assert [s.temperature for s in steps] == [0.75, 0.5, 0.25, 0.0]
    full = [1024, 1019, 1006, 984, 954, 916, 870, 817, 756, 689, 617, 539, 456, 369, 280, 188, 94, 1]
    assert [s.hidden for s in schedule_steps(1024)] == full
