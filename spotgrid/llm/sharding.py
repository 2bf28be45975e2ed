"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups are weighed by a keyed sum.  A group heavier than one part in ``items`` of
everything is an item of its own (there are at most ``items`` such groups); all
lighter groups fall by hash into ``items`` bundles, so that at most ``2 * items``
items, whatever the size of the data, are sorted by size and go one by one to the
least-loaded shard through a heap.  Rows then look up their item, and are numbered
within (shard, slice of ids), with the slices' counts added up before them.

Rows: a null text has no bytes and forms a group with other null texts, apart from
the empty text; null and repeated ids are rows like any other, and rows alike in all
columns may swap slots; an empty table gives an empty table; only the named columns
are used, so clashing names cannot arise.  A group larger than a shard's share
makes that shard larger, since groups stay together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotgrid.llm.common import stored
from spotgrid.llm.registry import query, table

#: Bundles of light groups; also the bound on heavy groups.
ITEMS = 8192
#: Rows per slice of ids, within which slots are numbered by a window.
SLICE_ROWS = 16384


def least_loaded(sizes: dict, shards: int) -> dict:
    """Longest processing time: items by falling size, ties by key, each to the least-loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for key, size in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        placed[key] = shard
    return placed


def _bundle(group: str, items: int) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(items)).cast("int")


def assign_shards(rows: DataFrame, group: str, size: str, shards: int, items: int = ITEMS) -> DataFrame:
    """``rows`` with a column ``shard``; rows of one ``group`` (a string, not null) share it.

    ``rows`` is read three times and should be a stored table.
    """
    groups = rows.groupBy(group).agg(F.sum(size).alias("bytes"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    limit = total // items
    heavy = F.col("bytes") > limit  # fewer than `items` groups can be
    key = F.when(heavy, F.col(group)).otherwise(F.lpad(_bundle(group, items).cast("string"), 8, "0"))
    weighed = groups.groupBy(key.alias("item"), heavy.alias("heavy")).agg(F.sum("bytes").alias("bytes"))
    found = {(r["heavy"], r["item"]): r["bytes"] for r in weighed.collect()}  # at most 2 * items rows
    placed = least_loaded(found, shards)
    spark = rows.sparkSession
    alone = [(item, shard) for (is_heavy, item), shard in placed.items() if is_heavy]
    packed = [(int(item), shard) for (is_heavy, item), shard in placed.items() if not is_heavy]
    alone_at = F.broadcast(spark.createDataFrame(alone, f"{group} string, alone int"))
    packed_at = F.broadcast(spark.createDataFrame(packed, "bundle int, packed int"))
    joined = rows.withColumn("bundle", _bundle(group, items)).join(alone_at, group, "left").join(packed_at, "bundle", "left")
    return joined.withColumn("shard", F.coalesce("alone", "packed")).drop("bundle", "alone", "packed")


def number_slots(rows: DataFrame, order: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each shard.  ``order[0]`` is the id that deals rows to slices."""
    slices = max(1, -(-rows.count() // slice_rows))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64(order[0]), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(*order)) - 1
    return sliced.withColumn("within", within).join(offsets, ["shard", "slice"]).withColumn("slot", F.col("within") + F.col("offset")).drop("slice", "within", "offset")


def shard_texts(docs: DataFrame, shards: int, items: int = ITEMS, slice_rows: int = SLICE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in shards of near equal bytes; equal texts stay together.

    Returns ``doc_id, size, text_crc32, group_key, shard, slot``.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content).cast("bigint") + 16).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col(text), 256), F.lit("null")).alias("group_key"),
    )
    slim = stored(slim, "shard-rows")
    placed = stored(assign_shards(slim, "group_key", "size", shards, items), "shard-placed")
    return number_slots(placed, ["doc_id", "group_key"], slice_rows)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by bytes."""
    placed = shard_texts(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_key")
