"""Vector codes against a brute-force version."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotgrid.llm import vector_codes
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows, parts, entries, rounds, scale=1024):
    """``[(vec_id, codes, error)]`` and the codebooks, by plain loops; rows of (vec_id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v in kept), default=0) // parts)) * parts
    whole = [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v)), v) for i, v in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    step = width // parts
    cut = [[w[p * step : (p + 1) * step] for p in range(parts)] for _, w, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[math.floor(sum(x) / len(members[k])) for x in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(w[0], bytes(k for _, k in f), sum(d for d, _ in f)) for w, f in zip(whole, found)], books


def digest(books):
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def test_odd_rows(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)], i % 2 or None) for i in range(40)]
    rows += [(3, [0.5] * 6, 7), (3, [0.5] * 6, 7), (None, [1.0, -1.0], 1), (90, [], 1), (91, None, 1), (92, [1.0, None], 1), (93, [float("nan")], 1), (94, [float("inf")], 1), (95, [0.0] * 6, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("error_", F.lit("x"))
    books = vector_codes.fit(frame, parts=4, entries=16, rounds=3)
    want, plain_books = plain([r[:2] for r in rows], 4, 16, 3)
    assert books.sha256() == digest(plain_books)
    got = vector_codes.encode(frame, books)
    assert sorted((repr(r["vec_id"]), bytes(r["codes"]), r["error"]) for r in got.collect()) == sorted((repr(i), c, e) for i, c, e in want)
    assert vector_codes.fit(frame.where("vec_id = 91")) is None
    with pytest.raises(ValueError, match="columns exist"):
        vector_codes.encode(frame.withColumnRenamed("error_", "error"), books)


def test_label_totals_of_heavy_and_light_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HEAVY_SHARE", 4)
    rows = [(i, None if i % 3 == 0 else 1 if i % 3 == 1 else i, 10**i % 997) for i in range(60)]
    got = vector_codes.label_totals(spark.createDataFrame(rows, "vec_id long, label long, error long"), "label", "error", "total").collect()
    sums = {}
    for _, label, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert sorted((r["vec_id"], r["total"]) for r in got) == [(i, sums[label]) for i, label, _ in rows]


def test_cells_leave_out_entries_and_are_remembered():
    draw = np.random.default_rng(2)
    centers = draw.integers(-4000, 4000, (256, 4))
    points = centers[draw.integers(0, 256, 5000)] + draw.integers(-60, 60, (5000, 4))
    cache = vector_codes.CellCache(centers, 256)
    codes, distances = cache.nearest(points)
    every = ((points[:, None] - centers) ** 2).sum(axis=2)
    assert (codes == every.argmin(axis=1)).all() and (distances == every.min(axis=1)).all()
    assert cache.evaluated < 0.1 * every.size
    before = cache.worked_out
    assert before < 0.6 * len(points)
    cache.nearest(points[:500])
    assert cache.worked_out == before
    small = vector_codes.CellCache(centers, 256, most=64)  # a cache too small for the cells forgets and stays right
    for at in range(0, 5000, 250):
        assert (small.nearest(points[at : at + 250])[0] == codes[at : at + 250]).all()


def test_whole_table_and_empty_table(spark, tmp_path):
    got = {r["vec_id"]: r for r in QUERIES["op13_vector_codes"](spark, FOLDER).collect()}
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    books = vector_codes.fit(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), rounds=1)
    assert books.sha256() == digest(plain(rows, 4, 256, 1)[1])
    assert len(got) == len(rows) and all(len(r["code"]) == 8 and r["label_error"] >= r["error"] for r in got.values())
    spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op13_vector_codes"](spark, str(tmp_path)).count() == 0
