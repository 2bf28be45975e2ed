"""Queries whose work grows with the table, on more rows than the smallest data has."""

import os

import duckdb
import pytest

from spotgrid.catalog import QUERIES, SQL
from spotgrid.operators import matrix

LARGER = "/root/testdata/sf0.1"


def test_training_flow_closes_epochs_on_larger_tables(spark):
    got = QUERIES["train_flow"](spark, LARGER).collect()
    # 1500 training samples are 47 batches a pass; 2.4 passes are 113 steps.
    assert sorted((r["step"], r["epoch"]) for r in got if r["key"] == "valid") == [(46, 1), (93, 2)]
    (told,) = [r for r in got if r["key"] == "told"]
    assert told["step"] == 112 and told["value"] > 1500 * 16


def test_cycled_batches_make_whole_passes_on_larger_tables(spark):
    customers = spark.read.parquet(f"{LARGER}/customer.parquet").count()
    out = QUERIES["cycle_batches"](spark, LARGER)
    assert [out.where(f"epoch = {i}").select("c_custkey").distinct().count() for i in (0, 1)] == [customers, customers]


@pytest.mark.parametrize("n", [40, 1700])
def test_cycled_batches_make_all_their_steps(spark, tmp_path, n):
    spark.range(n).selectExpr("id + 1 AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["cycle_batches"](spark, str(tmp_path)).toPandas()
    batches = -(-n // 4)
    steps = max(100, -(-2 * batches // 8))
    assert sorted(got["step"].unique()) == list(range(steps)) and steps >= 100
    assert len(got) == sum(len(range(b % batches * 4, min(n, b % batches * 4 + 4))) for b in range(8 * steps))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        told = db.execute(SQL["cycle_batches"]).fetchall()
    assert sorted(told) == sorted(got.itertuples(index=False, name=None))


def test_counts_of_long_conversations_stay(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    for name in os.listdir(small):
        if name != "conversations.parquet":
            (tmp_path / name).symlink_to(f"{small}/{name}")
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    gene = spark.read.parquet(f"{small}/pages.parquet").first()["page_id"]
    longer = spark.createDataFrame([(gene, 11, "x" * 77)], "conv_id long, turn long, text string")
    turns.select(*longer.columns).where(f"conv_id <> {gene}").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "text").union(longer).write.parquet(str(tmp_path / "conversations.parquet"))
    dense = QUERIES["dense_counts"](spark, str(tmp_path)).where("cell_idx = 11 and value <> 0").collect()
    assert [(r["gene_idx"], r["value"]) for r in dense] == [(gene, 77.0)]
    paired = QUERIES["paired_arrays"](spark, str(tmp_path))
    assert paired.where("part = 'count'").agg({"pos": "max"}).first()[0] == 11


def test_cells_beyond_the_vector_raise(spark):
    counts = spark.createDataFrame([(0, 1, 2.0), (0, 4, 3.0)], "gene_idx int, cell_idx int, count float")
    with pytest.raises(Exception, match="beyond 4 cells"):
        matrix.gene_vector_blocks(counts, 4, 2).collect()
