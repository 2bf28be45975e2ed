"""Sharding: the heap, groups, balance and slots."""

import zlib

from spotgrid.llm import sharding
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def check(rows, texts, shards):
    """Groups together, sizes, checksums, gapless slots; returns loads."""
    by_text, slots, loads = {}, {}, [0] * shards
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
        by_text.setdefault((r["text_crc32"], r["size"], r["group_key"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert want == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows)
    return loads


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = QUERIES["op2_sharding"](spark, FOLDER).collect()
    loads = check(rows, docs, 40)
    assert max(loads) - min(loads) <= max(r["size"] for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op2_sharding"](spark, FOLDER).collect()))


def test_bundles_hot_groups_nulls_and_slices(spark):
    docs = [(i, "hot" * 50) for i in range(300)] + [(i, f"text {i}" * (i % 5)) for i in range(500)] + [(None, None), (None, None), (1, ""), (1, "")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, shard int")
    loads = check(sharding.shard_texts(df, 7, items=64, slice_rows=50).collect(), docs, 7)
    hot = 300 * 166
    assert max(loads) == hot
    rest = sorted(loads)[:-1]
    assert max(rest) - min(rest) <= sum(loads) / 32
    assert sharding.shard_texts(df.where("false"), 7).count() == 0


def test_least_loaded():
    assert sharding.least_loaded({"a": 5, "b": 4, "c": 3, "d": 3, "e": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert sharding.least_loaded({}, 3) == {}


def plain_schedule(rows, bundles, shards, items):
    """Shard of each group: heavy groups and bundles of the others, by falling size, each to the shard of the least load, found by a scan."""
    limit = sum(r["size"] for r in rows) // items
    groups = {}
    for r in rows:
        groups[r["group_key"]] = groups.get(r["group_key"], 0) + r["size"]
    item_of = {g: (True, g) if n > limit else (False, f"{bundles[g]:08d}") for g, n in groups.items()}
    sizes = {}
    for g, n in groups.items():
        sizes[item_of[g]] = sizes.get(item_of[g], 0) + n
    loads, placed = [0] * shards, {}
    for item in sorted(sizes, key=lambda i: (-sizes[i], i)):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        loads[shard] += sizes[item]
        placed[item] = shard
    return {g: placed[i] for g, i in item_of.items()}


def test_shards_against_a_plain_schedule(spark):
    from pyspark.sql import functions as F

    docs = [(i, "hot" * 50) for i in range(120)] + [(i, f"text {i % 300} " * (i % 7)) for i in range(900)] + [(None, None), (7, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for given, shards, items in ((frame, 7, 64), (spark.read.parquet(f"{FOLDER}/documents.parquet"), 40, sharding.ITEMS)):
        rows = sharding.shard_texts(given, shards, items=items).collect()
        keys = spark.createDataFrame([(k,) for k in {r["group_key"] for r in rows}], "k string")
        bundles = {r["k"]: r["b"] for r in keys.select("k", F.pmod(F.xxhash64("k"), F.lit(items)).alias("b")).collect()}
        want = plain_schedule(rows, bundles, shards, items)
        assert all(r["shard"] == want[r["group_key"]] for r in rows)
