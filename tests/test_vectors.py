import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spotgrid.operators import codebook, lookup, matrix, vector_sums
from spotgrid.operators.meeting import CORE_GROUPS, meet

RNG = np.random.default_rng(3)


def vectors(spark, data, name="vec"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"id int, {name} array<double>")


def book(spark, data):
    return vectors(spark, data).withColumnRenamed("id", "code_id")


@pytest.mark.parametrize("limit", [1, 200, 1 << 30])
def test_assign_codes_by_brute_force(spark, limit):
    codes, vecs = RNG.normal(size=(23, 5)), RNG.normal(size=(200, 5))
    sims = (vecs / np.linalg.norm(vecs, axis=1)[:, None]) @ (codes / np.linalg.norm(codes, axis=1)[:, None]).T
    got = codebook.assign_codes(vectors(spark, vecs), book(spark, codes), limit)
    assert [r["code_id"] for r in sorted(got.collect(), key=lambda r: r["id"])] == sims.argmax(axis=1).tolist()


@pytest.mark.parametrize("limit", [1, 1 << 30])
def test_ties_take_the_lowest_code(spark, limit):
    codes = [[1, 0], [0, 3], [2, 0], [0, 1]]
    got = codebook.assign_codes(vectors(spark, [[5, 0], [0, 0.1], [0, 0]]), book(spark, codes), limit)
    assert [r["code_id"] for r in sorted(got.collect(), key=lambda r: r["id"])] == [0, 1, 0]


def test_sum_vectors_matches_numpy_and_flushes(spark):
    vecs, keys = RNG.normal(size=(500, 4)), RNG.integers(0, 6, 500)
    data = [(int(k), [float(x) for x in v]) for k, v in zip(keys, vecs)]
    df = spark.createDataFrame(data, "k int, vec array<double>").repartition(5)
    for limit in (1, 1 << 20):
        got = {r["k"]: r for r in vector_sums.sum_vectors(df, "k", limit).collect()}
        for k in range(6):
            assert got[k]["n"] == int((keys == k).sum())
            assert np.allclose(got[k]["total"], vecs[keys == k].sum(axis=0))


@pytest.mark.parametrize("limit", [1, 300, 1 << 30])
def test_sparse_times_dense(spark, limit):
    dense = RNG.normal(size=(40, 3))
    entries = {(int(r), int(c)): float(v) for r, c, v in zip(RNG.integers(0, 7, 150), RNG.integers(0, 40, 150), RNG.normal(size=150))}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in entries.items()], "r int, c int, v double")
    want = np.zeros((7, 40))
    for (r, c), v in entries.items():
        want[r, c] = v
    got = vector_sums.sparse_times_dense(df, "r", "c", "v", vectors(spark, dense), limit).collect()
    for r in got:
        assert np.allclose(r["total"], want[r["r"]] @ dense)


def test_tokenize_round_trip_up_to_scale(spark):
    from spotgrid.operators.raster import patch_vectors

    pixels = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 2.0), (0, 3, 2, 4.0), (1, 0, 3, 3.0)], "gene_idx int, px int, py int, value float")
    found = [r["vec"] for r in patch_vectors(pixels, 4, 1).collect()]
    codes = book(spark, [[0, 0, 0, 0], *found])
    tokens = codebook.tokenize(pixels, codes, 4, 1)
    assert tokens.count() == 8
    assert rows(codebook.detokenize(tokens, codes, 4, 1)) == rows(pixels)


def test_fit_loop_lowers_the_loss(spark):
    centres = RNG.normal(size=(4, 6)) * 3
    data = np.concatenate([c + RNG.normal(size=(40, 6)) * 0.3 for c in centres] + [np.zeros((5, 6))])
    vecs = vectors(spark, data)
    learned = codebook.fit_codebook(vecs, k=5, seed=1)
    assert learned.where("code_id = 0").first()["vec"] == [0.0] * 6
    start = book(spark, data[:5])
    loss = lambda b: codebook.commitment_loss(codebook.assign_codes(vecs, b), b).first()["loss"]
    assert loss(learned) < loss(start)
    state, seen = start.select("code_id", F.lit(1.0).alias("n"), F.col("vec").alias("total")), [loss(start)]
    current = start
    for _ in range(3):
        step = codebook.ema_update(state, codebook.assign_codes(vecs, current))
        step = spark.createDataFrame(step.collect(), step.schema)
        state, current = step.select("code_id", "n", "total"), step.select("code_id", "vec")
        seen.append(loss(current))
    assert seen[-1] < seen[0]


def test_ema_without_members_only_decays(spark):
    state = spark.createDataFrame([(0, 2.0, [4.0, 2.0]), (1, 1.0, [1.0, 0.0])], "code_id int, n double, total array<double>")
    members = spark.createDataFrame([(1, [3.0, 4.0])], "code_id int, vec array<double>")
    got = {r["code_id"]: r for r in codebook.ema_update(state, members, 0.5).collect()}
    assert got[0]["n"] == 1.0 and got[0]["total"] == [2.0, 1.0] and got[0]["vec"] == [2.0, 1.0]
    assert got[1]["n"] == 1.0 and got[1]["total"] == [2.0, 2.0]
    unit = codebook.ema_update(state, members, 0.5, normalize=True).where("code_id = 1").first()["vec"]
    assert np.allclose(unit, [0.5**0.5] * 2)


@pytest.mark.parametrize("limit", [1, 400, 1 << 30])
def test_soft_lookup_by_brute_force(spark, limit):
    queries, keys, values = RNG.normal(size=(30, 4)), RNG.normal(size=(17, 4)), RNG.normal(size=(17, 2))
    usable = [i % 5 != 2 for i in range(17)]
    context = spark.createDataFrame(
        [(i, [float(x) for x in k], [float(x) for x in v], u) for i, (k, v, u) in enumerate(zip(keys, values, usable))],
        "key_id int, key_vec array<double>, value_vec array<double>, usable boolean",
    )
    null_key, null_value = [1.0, 2.0, 0.0, 0.0], [9.0, -9.0]
    got = lookup.soft_lookup(vectors(spark, queries).withColumnRenamed("id", "query_id"), context, null_key, null_value, limit=limit)
    all_keys = np.concatenate([keys[usable], [null_key]])
    all_values = np.concatenate([values[usable], [null_value]])
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    weights = np.exp(8 * unit(queries) @ unit(all_keys).T)
    want = weights @ all_values / weights.sum(axis=1)[:, None]
    assert np.allclose([r["result"] for r in sorted(got.collect(), key=lambda r: r["query_id"])], want)


def test_soft_lookup_without_usable_context(spark):
    context = spark.createDataFrame([(0, [1.0], [5.0], False)], "key_id int, key_vec array<double>, value_vec array<double>, usable boolean")
    got = lookup.soft_lookup(vectors(spark, [[2.0]]).withColumnRenamed("id", "query_id"), context, [1.0], [7.0])
    assert got.first()["result"] == [7.0]


def test_embedding_shape_of_the_smoke_case(spark):
    counts = spark.range(50 * 100).selectExpr(
        "cast(id div 100 as int) as gene_idx", "cast(id % 100 as int) as cell_idx", "cast(pmod(hash(id), 100) as float) as count"
    )
    cells = counts.select("cell_idx").distinct()
    context = matrix.embed_counts(counts, matrix.cell_embedding(cells, 18, 0))
    assert context.count() == 5000 and rows(context.select(F.size("vec")).distinct()) == [(19,)]
    assert rows(matrix.context_mask(context).groupBy("gene_idx").count().select("count").distinct()) == [(19,)]


def test_gene_vectors_and_blocks(spark):
    counts = spark.createDataFrame([(0, 1, 5.0), (0, 6, 2.0), (1, 3, 1.0)], "gene_idx int, cell_idx int, count float")
    whole = {r["gene_idx"]: list(r["counts"]) for r in matrix.gene_vectors(counts, 7).collect()}
    assert whole == {0: [0, 5, 0, 0, 0, 0, 2], 1: [0, 0, 0, 1, 0, 0, 0]}
    blocks = {(r["gene_idx"], r["block"]): list(r["counts"]) for r in matrix.gene_vector_blocks(counts, 7, 4).collect()}
    assert blocks == {(0, 0): [0, 5, 0, 0], (0, 1): [0, 0, 2], (1, 0): [0, 0, 0, 1]}
    with pytest.raises(ValueError):
        matrix.gene_vectors(counts, matrix.MAX_VECTOR + 1)
    genes = spark.createDataFrame([(0,), (1,), (2,)], "gene_idx int")
    dense = matrix.dense_counts(counts, 7, genes, block=4)
    assert dense.count() == 21 and dense.where("count != 0").count() == 3 and dense.where("gene_idx = 2").count() == 7
    assert {r["gene_idx"]: list(r["counts"]) for r in matrix.gene_vectors(counts, 7, genes).collect()}[2] == [0] * 7


def plain_lookup(queries, keys, values, null_key, null_value, heads):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    keys, values = np.concatenate([keys, [null_key]]), np.concatenate([values, [null_value]])
    out = []
    for q, k, v in zip(*(np.split(m, heads, axis=1) for m in (queries, keys, values))):
        weights = np.exp(8 * unit(q) @ unit(k).T)
        out.append(weights @ v / weights.sum(axis=1)[:, None])
    return np.concatenate(out, axis=1)


def lookup_context(spark, keys, values, usable=None, groups=None):
    listed = [(i, [float(x) for x in k], [float(x) for x in v], usable is None or usable[i], groups[i] if groups else 0) for i, (k, v) in enumerate(zip(keys, values))]
    return spark.createDataFrame(listed, "key_id int, key_vec array<double>, value_vec array<double>, usable boolean, sample long")


@pytest.mark.parametrize("limit", [400, 1 << 30])
def test_soft_lookup_with_heads(spark, limit):
    queries, keys, values = RNG.normal(size=(40, 6)), RNG.normal(size=(19, 6)), RNG.normal(size=(19, 4))
    queries[3, :3] = 0
    null_key, null_value = [1.0, 0, 0, 2.0, 0, 0], [9.0, -9.0, 1.0, 2.0]
    got = lookup.soft_lookup(vectors(spark, queries).withColumnRenamed("id", "query_id"), lookup_context(spark, keys, values), null_key, null_value, limit=limit, heads=2)
    want = plain_lookup(queries, keys, values, null_key, null_value, 2)
    assert np.allclose([r["result"] for r in sorted(got.collect(), key=lambda r: r["query_id"])], want)
    with pytest.raises(ValueError, match="heads"):
        lookup.soft_lookup(vectors(spark, queries), lookup_context(spark, keys, values), null_key, null_value, heads=4)


def test_soft_lookup_in_the_own_context(spark):
    """One sample has most rows and several blocks; one has no context; one key is null, one query too."""
    queries, keys, values = RNG.normal(size=(50, 3)), RNG.normal(size=(40, 3)), RNG.normal(size=(40, 2))
    q_of, k_of = [0 if i < 35 else i % 4 for i in range(50)], [0 if i < 30 else 1 + i % 2 for i in range(40)]
    context = lookup_context(spark, keys, values, groups=k_of)
    context = context.unionByName(spark.createDataFrame([(99, None, [1.0, 1.0], True, 0), (98, [1.0, 1.0, 1.0], None, True, 0), (97, [1.0, 1.0, 1.0], [5.0, 5.0], True, None)], context.schema))
    asked = [(i, [float(x) for x in q], g) for i, (q, g) in enumerate(zip(queries, q_of))] + [(50, None, 0), (51, [1.0, None, 0.0], None)]
    frame = spark.createDataFrame(asked, "query_id int, vec array<double>, sample long")
    got = {r["query_id"]: r["result"] for r in lookup.soft_lookup(frame, context, [1.0, 0, 0], [3.0, 4.0], limit=300, by="sample").collect()}
    assert len(got) == 52
    for i, g in enumerate(q_of + [0, None]):
        own = [j for j in range(40) if k_of[j] == g]
        q = queries[i] if i < 50 else np.zeros(3) if i == 50 else np.array([1.0, 0, 0])
        assert np.allclose(got[i], plain_lookup(q[None], keys[own], values[own], [1.0, 0, 0], [3.0, 4.0], 1)[0])
    assert np.allclose(got[51], [3.0, 4.0])


def test_null_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0]), (3, None), (None, [7.0, 7.0])], "code_id int, vec array<double>").coalesce(1)
    got = {r["code_id"]: (r["n"], r["total"]) for r in codebook.code_sums(rows).collect()}
    assert got == {0: (1, [1.0, 2.0]), 2: (1, [3.0, 4.0])}
    codes = book(spark, [[0, 0], [1, 0], [0, 1]])
    for limit in (1, 1 << 30):
        found = codebook.assign_codes(rows.withColumnRenamed("code_id", "id"), codes, limit)
        assert [r["code_id"] for r in sorted(found.collect(), key=lambda r: 9 if r["id"] is None else r["id"])] == [2, 0, 2, 0, 1]
    uneven = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "code_id int, vec array<double>").coalesce(1)
    for call in (lambda: codebook.code_sums(uneven), lambda: codebook.assign_codes(uneven.withColumnRenamed("code_id", "id"), codes)):
        with pytest.raises(Exception, match="components of the others"):
            call().collect()


def test_more_codes_than_the_limit_pass_no_driver(spark, monkeypatch):
    codes, vecs = RNG.normal(size=(300, 8)), RNG.normal(size=(500, 8))
    frame, many = vectors(spark, vecs).withColumn("other", F.lit("kept")), book(spark, codes)
    for name in ("toArrow", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(type(many), name, lambda *a, **b: pytest.fail("rows reach the driver"))
    got = codebook.assign_codes(frame, many, limit=4000).select("id", "other", "code_id", "sim")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan
    sims = (vecs / np.linalg.norm(vecs, axis=1)[:, None]) @ (codes / np.linalg.norm(codes, axis=1)[:, None]).T
    found = sorted(got.collect(), key=lambda r: r["id"])
    assert [r["code_id"] for r in found] == sims.argmax(axis=1).tolist() and {r["other"] for r in found} == {"kept"}


def test_sums_are_added_up_as_arrays(spark, monkeypatch):
    vecs, keys = RNG.normal(size=(3000, 7)), RNG.integers(0, 5, 3000)
    data = [(int(k), [float(x) for x in v]) for k, v in zip(keys, vecs)]
    df = spark.createDataFrame(data, "k int, vec array<double>").repartition(9)
    for tasks in (64, 2):  # one level, and two
        monkeypatch.setattr(vector_sums, "MERGED_TASKS", tasks)
        out = vector_sums.sum_vectors(df, "k")
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        for r in out.collect():
            assert r["n"] == int((keys == r["k"]).sum()) and np.allclose(r["total"], vecs[keys == r["k"]].sum(axis=0))


def test_sparse_times_large_dense_with_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(vector_sums, "BLOCK_ENTRIES", 50)
    dense = RNG.normal(size=(60, 3))
    entries = [(i % 11, int(c), float(v)) for i, (c, v) in enumerate(zip(np.where(RNG.random(900) < 0.7, 2, RNG.integers(0, 80, 900)), RNG.normal(size=900)))]
    df = spark.createDataFrame(entries + [(None, 1, 2.0), (1, None, 2.0), (1, 1, None)], "r int, c int, v double")
    want = np.zeros((11, 80))
    for r, c, v in entries:
        want[r, c] += v
    got = vector_sums.sparse_times_dense(df, "r", "c", "v", vectors(spark, dense), 1000)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    found = {r["r"]: r["total"] for r in got.collect()}
    assert set(found) == set(range(11)) and all(np.allclose(found[r], want[r, :60] @ dense) for r in found)


def test_many_small_groups_of_one_table_meet_in_slices(spark):
    rng = np.random.default_rng(4)
    many, each = 500, 3
    vectors = rng.normal(size=(many * each, 2))
    data = [(i, i % many, v.tolist()) for i, v in enumerate(vectors)]
    base = spark.createDataFrame(data, "id bigint, own int, vec array<double>").checkpoint()
    queries = base.select(F.col("id").alias("query_id"), "vec", "own")
    context = base.select(F.col("id").alias("key_id"), F.col("vec").alias("key_vec"), F.col("vec").alias("value_vec"), (F.col("id") < many * 2).alias("usable"), "own")
    got = {r["query_id"]: r["result"] for r in lookup.soft_lookup(queries, context, [1.0, 0.0], [0.5, 0.5], by="own").collect()}
    assert len(got) == len(vectors)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    for i, v in enumerate(vectors):
        seen = vectors[[j for j in range(i % many, many * 2, many)]]
        keys, values = np.vstack([seen, [[1.0, 0.0]]]), np.vstack([seen, [[0.5, 0.5]]])
        weights = np.exp(8.0 * unit(keys) @ unit(v))
        assert np.allclose(got[i], weights @ values / weights.sum())


def test_work_sees_all_pieces_of_a_group_at_once(spark):
    left = spark.range(4000).selectExpr("id AS _row", "id % 1000 AS own")
    right = spark.range(2000).selectExpr("id AS _id", "id % 1000 AS own")

    def count(one, two, pieces):
        mine, theirs = one.column("_by").to_pylist(), two.column("_by").to_pylist()
        same = all(len({*mine[at : at + n], *theirs[to : to + m]}) == 1 for at, n, to, m in pieces)
        return pa.table({"calls": [1], "pairs": [sum(n * m for _, n, _, m in pieces)], "same": [same]})

    found = meet(left, right, 1000, 1000, count, "calls bigint, pairs bigint, same boolean", by="own").collect()
    assert sum(r["pairs"] for r in found) == 8000 and all(r["same"] for r in found)
    assert sum(r["calls"] for r in found) <= CORE_GROUPS * spark.sparkContext.defaultParallelism < 1000


def test_assigning_holds_one_small_block_of_similarities():
    codes, vecs = RNG.normal(size=(160, 4)), RNG.normal(size=(20000, 4))
    ids, units = codebook._units(pa.table({"code_id": pa.array(range(160), pa.int32()), "vec": codes.tolist()}))
    given = pa.array(vecs.tolist())
    tracemalloc.start()
    code, _ = codebook._best_codes(given, ids, units)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    sims = (vecs / np.linalg.norm(vecs, axis=1)[:, None]) @ (codes / np.linalg.norm(codes, axis=1)[:, None]).T
    assert np.array_equal(code, np.round(sims, 9).argmax(axis=1)) and peak < 10 << 20
