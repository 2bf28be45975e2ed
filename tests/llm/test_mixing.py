"""Mixing: targets, epochs and fractions, and rows that repeat."""

from collections import Counter

import pytest

from spotgrid.llm import mixing
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, cap, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 7, "b": 7, None: 7}, {"a": 0, "b": 9}, {"a": 1, "b": 1, "c": 1, "d": 997, "e": 2}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_every_source_comes_near_its_target(spark):
    rows = QUERIES["op6_mixing"](spark, FOLDER).collect()
    again = QUERIES["op6_mixing"](spark.newSession(), FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
    for (_, target), own in by_source.items():
        assert abs(sum(r["taken"] for r in own) - target) <= 0.03 * target


def plain_taken(rows, target, source_size):
    """Three cuts in key order, each passing over what is larger than the rest, then the document of the nearest size; rows of (key, size)."""
    epochs = int(target // source_size)
    left, sampled = target - epochs * source_size, set()
    ordered = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for _ in range(1 + mixing.FILLS):
        upto, spent = 0, 0
        for i in [i for i in ordered if i not in sampled and 0 < rows[i][1] <= left]:
            upto += rows[i][1]
            if upto <= left:
                sampled.add(i)
                spent = upto
        left -= spent
    rest = [i for i in ordered if i not in sampled and rows[i][1]]
    best = min(rest, key=lambda i: abs(left - rows[i][1]), default=None)
    if best is not None and abs(left - rows[best][1]) < left:
        sampled.add(best)
    return {i: epochs + (i in sampled) for i in range(len(rows))}


def test_weights_of_a_column_and_the_cut_by_hand(spark):
    """Weights outside the bounds, null and NaN; a long document at the cut makes room for later ones."""
    import hashlib
    import math

    sizes = [40, 7, 300, 5, 12, 60, 9, 33, 2, 18]
    weights = [1.0, 0.5, None, float("nan"), 7.0, 0.0, 0.3, 0.9, 0.25, 0.7]
    docs = spark.createDataFrame([(i, "s", "w " * n, w) for i, (n, w) in enumerate(zip(sizes, weights))] + [(99, "t", "x " * 5, 1.0)], "doc_id long, source string, text string, w double")
    got = {r["doc_id"]: r for r in mixing.mix(docs, weight="w", slice_rows=3).collect()}
    bounded = [min(1.0, max(0.25, 0.25 if w is None or w != w else w)) for w in weights]
    keys = []
    for i, n in enumerate(sizes):
        digest = hashlib.md5(f"{mixing.SEED}:{i}:{hashlib.md5(('w ' * n).encode()).hexdigest()}".encode()).hexdigest()
        keys.append(-math.log((int(digest[:13], 16) + 0.5) / 2**52) / bounded[i])
    want = plain_taken(list(zip(keys, sizes)), got[0]["target"], sum(sizes))
    assert {i: got[i]["copies"] for i in range(len(sizes))} == want
    taken = mixing.take(docs, weight="w")
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got.values())


def test_small_slices_change_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ("doc_id", "size", "copies", "taken")
    one = sorted(map(tuple, mixing.mix(docs).select(*names).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs, slice_rows=7).select(*names).collect()))


def test_rows_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c", None, "x"), (1, "a b c", None, "x"), (2, None, "s", "y"), (None, "w " * 5, "s", None), (None, "", "s", "z"), (3, "q " * 40000, "t", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert {r["size"] for r in got if r["doc_id"] == 2} == {0}
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    want = Counter()
    for r in got:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    found = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in taken.collect())
    assert found == +want
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.take(docs.where("false")).count() == 0
