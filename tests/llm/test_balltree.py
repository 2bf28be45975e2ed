"""Exact search against a scan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotgrid.llm import balltree


def plain(rows, k):
    """query_id, rank, vec_id, score for rows of id and vector; queries are even ids."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 2 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
            out += [(i, rank + 1, j, min(max(-s, balltree.LOW), balltree.HIGH)) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, k, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("mine"))
    vectors = df.select("shard", "vec_id", balltree.whole_vectors("embedding").alias("vector"))
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in balltree.top_k(vectors, F.col("vec_id") % 2 == 0, k, **sizes).collect())


@pytest.mark.parametrize("sizes", [{"shard_rows": 25, "block_rows": 20, "leaf_rows": 4}, {}])
def test_clusters_ties_and_copies(spark, sizes):
    draw = random.Random(5)
    centers = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + draw.gauss(0, 0.1) for c in draw.choice(centers)]) for i in range(90)]
    rows += [(i, [0.25] * 6) for i in range(90, 120)]  # one common vector
    assert search(spark, rows, 7, **sizes) == plain(rows, 7)


def test_rows_that_take_no_part_lengths_and_large_numbers(spark):
    rows = [(2, [1.0, 2.0]), (4, None), (6, [1.0, None]), (8, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(3, [1.0]), (5, []), (7, [3e15, -2e15]), (12, [4e12, 1.5]), (1, [-5.0, 1.0, 9.0]), (9, [1e17, 1e17]), (14, [1e17, 3.0])]
    got = search(spark, rows, 3)
    assert got == plain(rows, 3)
    assert search(spark, rows[:1], 3) == []
    assert balltree.top_k(spark.createDataFrame([], "vec_id long, vector array<double>"), F.col("vec_id") % 2 == 0, 3).count() == 0


def test_a_query_is_not_its_own_candidate_even_if_repeated(spark):
    rows = [(2, [1.0]), (2, [1.0]), (3, [0.5]), (3, [0.5])]
    assert {(r[0], r[2]) for r in search(spark, rows, 5)} == {(2, 3)}


def test_clustered_vectors_are_pruned(monkeypatch):
    """Far clusters are never multiplied: a small share of all products, and the same hits as a scan."""
    draw = np.random.default_rng(6)
    centers = draw.normal(size=(60, 8)) * 400
    vectors = np.floor(centers[draw.integers(0, 60, 8000)] + draw.normal(size=(8000, 8)) * 20)
    ids, queries = np.arange(8000), np.arange(0, 8000, 100)
    tree = balltree.BallTree.build(vectors, ids, 64)
    counted, plain = [], balltree._products
    monkeypatch.setattr(balltree, "_products", lambda q, v: counted.append(len(q) * len(v)) or plain(q, v))
    q, found, scores = tree.search(vectors[queries], queries, 20, np.full(len(queries), -np.inf))
    assert sum(counted) < 0.2 * len(queries) * len(vectors)
    every = vectors[queries] @ vectors.T
    every[np.arange(len(queries)), queries] = -np.inf
    for i in range(len(queries)):
        order = np.lexsort((ids, -every[i]))[:20]
        assert found[q == i].tolist() == order.tolist() and scores[q == i].tolist() == every[i][order].tolist()
