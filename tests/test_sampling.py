import pytest
from conftest import rows
from pyspark.sql import functions as F

from spotgrid.operators import sampling


@pytest.mark.parametrize("n,train", [(20, 19), (25, 23), (33, 31), (100, 95), (1000, 950)])
def test_exact_sizes(spark, n, train):
    got = {r["split"]: r["count"] for r in sampling.exact_split(spark.range(n), "id").groupBy("split").count().collect()}
    assert got == {"train": train, "valid": n - train}


def test_split_is_a_cover_and_stable(spark):
    a = rows(sampling.exact_split(spark.range(500), "id"))
    b = rows(sampling.exact_split(spark.range(500).repartition(9), "id"))
    assert a == b and len({i for i, _ in a}) == 500
    both = sampling.exact_split(spark.range(10), "id", 0)
    assert both.count() == 20


@pytest.mark.parametrize("buckets", [None, 1, 3, 100_000])
def test_ranks_do_not_depend_on_buckets(spark, buckets):
    got = rows(sampling.random_ranks(spark.range(300), "id", 5, buckets=buckets).select("id", "rank", "total"))
    want = rows(sampling.random_ranks(spark.range(300), "id", 5, buckets=64).select("id", "rank", "total"))
    assert got == want and sorted(r[1] for r in got) == list(range(300))


def test_batches(spark):
    got = sampling.shuffle_batches(spark.range(10), "id", 4).groupBy("batch_id").count()
    assert rows(got) == [(0, 4), (1, 4), (2, 2)]
    first = rows(sampling.shuffle_batches(spark.range(50), "id", 4, epoch=0))
    second = rows(sampling.shuffle_batches(spark.range(50), "id", 4, epoch=1))
    assert first != second


def test_cycle(spark):
    got = sampling.cycle_batches(spark.range(10), "id", 4, steps=4, grad_accum=2).collect()
    # Three batches (4, 4, 2) per pass: steps take (4+4), (2+4), (4+2), (4+4) rows.
    sizes = {}
    for r in got:
        sizes[r["step"]] = sizes.get(r["step"], 0) + 1
    assert sizes == {0: 8, 1: 6, 2: 6, 3: 8}
    for epoch in (0, 1):
        assert sorted(r["id"] for r in got if r["epoch"] == epoch) == list(range(10))


def test_buckets_follow_the_rows_and_offsets_have_two_levels(spark):
    assert [sampling.buckets_of(n) for n in (0, 1, 65536, 65537, 10**11)] == [1, 1, 1, 2, 1525879]
    ranked = sampling.random_ranks(spark.range(4000), "id", 5, epoch=F.lit(2), buckets=5000)
    got = rows(ranked.select("id", "rank", "total"))
    assert got == rows(sampling.random_ranks(spark.range(4000), "id", 5, epoch=F.lit(2)).select("id", "rank", "total"))
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_coarse" in text
    assert sampling.random_ranks(spark.range(0), "id", 5).count() == 0 and sampling.cycle_batches(spark.range(0), "id", 4, 2).count() == 0
