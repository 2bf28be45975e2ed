"""SimHash near-duplicates: BK-trees over fingerprints, one tree per shard, and connected components.

A fingerprint is the majority of the bits of a text's shingle hashes.  Two
fingerprints at most ``radius`` bits apart agree in at least ``shared`` of
``radius + shared`` blocks of bits, so each distinct fingerprint goes to one shard
per choice of ``shared`` blocks, keyed by their values.  A shard's fingerprints
form a BK-tree (children keyed by their Hamming distance to the parent) that is
searched along edges within the radius.  Trees meet their queries by the shuffle
key and are not broadcast, since all trees together grow with the data; a shard of
more than ``TREE_ROWS`` fingerprints is cut into several trees, and every pair of
its parts is searched.

Out of a shard come the edges of a heap-shaped tree per group found, never all
pairs, so no node has many edges.  Components are the smallest labels reachable:
each round takes the least label among neighbours and follows labels of labels.

Rows: a null text counts as empty; texts without words have fingerprint zero and
are linked like any other; null ids belong to components but do not name them (a
component of null ids alone has a null id); repeated rows are rows of one
component; an empty table gives an empty table; other columns are ignored by
:func:`near_duplicates` and kept as they are by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.llm.common import stored, text_or_empty
from spotgrid.llm.registry import query, table
from spotgrid.plans.sizing import bounded

SEED = 42
RADIUS, SHARED, SHINGLE = 3, 2, 3
#: Fingerprints per BK-tree; rows per group of shards that one call works on.
TREE_ROWS, GROUP_ROWS = 2048, 8192
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned number: ASCII lower case, ``shingle`` words, XXH64."""
    words = (text or "").encode().lower().split()  # both act on ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    spans = list(zip(starts[: len(words) - last].tolist(), ends[last:].tolist()))
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + BLOCK]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """:func:`fingerprint` of a column, as a signed long with the same bits."""

    @F.pandas_udf("bigint")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return signed(text)


class BKTree:
    """Fingerprints with children keyed by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Hang a value below the node that has no child at its distance yet."""
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node != place:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), place)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values at most ``radius`` bits away."""
        open_nodes = [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            open_nodes += [child for edge, child in self.children[node].items() if -radius <= edge - distance <= radius]


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def link_shard(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Edges that join all values linked within a shard, or between two parts of one.

    Without ``query_side`` the values of ``tree_side`` are searched among themselves.
    """
    tree = BKTree()
    values = tree_side + (query_side or [])
    parent = list(range(len(values)))
    if query_side is not None:
        for value in tree_side:
            tree.add(value)
    first = len(tree_side) if query_side is not None else 0
    for place in range(first, len(values)):
        for hit in tree.within(values[place], radius):
            a, b = _root(parent, hit), _root(parent, place)
            parent[max(a, b)] = min(a, b)
        if query_side is None:
            tree.add(values[place])
    groups: dict[int, list[int]] = {}
    for place in range(len(values)):
        groups.setdefault(_root(parent, place), []).append(values[place])
    edges = []
    for members in groups.values():
        members.sort()
        edges += [(members[i], members[(i - 1) // 2]) for i in range(1, len(members))]
    return edges


def _link_groups(radius: int):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "part_a", "part_b", "part"], kind="stable")
        keys = rows[["shard", "part_a", "part_b"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
        values, parts = rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy()
        edges: list[tuple[int, int]] = []
        for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            own = values[start:end].tolist()
            if keys[start, 1] == keys[start, 2]:
                edges += link_shard(own, None, radius)
            else:
                border = int(np.searchsorted(parts[start:end], keys[start, 2]))
                edges += link_shard(own[:border], own[border:], radius)
        found = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return link


def shard_keys(fp: Column, radius: int, shared: int) -> Column:
    """One key per choice of ``shared`` of the ``radius + shared`` blocks: a hash of the choice and the blocks' bits."""
    n = radius + shared
    borders = [64 * i // n for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), shared)):
        mask = sum(((1 << (borders[i + 1] - borders[i])) - 1) << borders[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def link_fingerprints(distinct: DataFrame, n: int, radius: int = RADIUS, shared: int = SHARED, tree_rows: int = TREE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges ``u, v`` (fingerprints as longs) whose components are those of all links; ``n`` distinct rows of ``fp``.

    A hash stands for a shard's key: two keys that collide share a tree, which
    tests every distance anyway.
    """
    sharded = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius, shared)).alias("shard"))
    hot = stored(sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > tree_rows), "simhash-hot")
    parts = F.coalesce(F.ceil(F.col("rows") / tree_rows), F.lit(1)).cast("int")
    cut = sharded.join(bounded(hot, hot.count(), 32), "shard", "left").withColumn("parts", parts)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = paired.select("fp", "shard", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    tables = len(list(combinations(range(radius + shared), shared)))
    group = F.pmod(F.xxhash64("shard", "part_a", "part_b"), F.lit(max(1, -(-n * tables // group_rows)))).alias("group")
    return placed.withColumn("group", group).groupBy("group").applyInPandas(_link_groups(radius), "u bigint, v bigint").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges``: the smallest node reachable.

    A round costs three joins of tables as long as the edges; the number of rounds
    grows with the logarithm of the longest path.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(ahead, "label").select("node", "old", F.least("label", "next").alias("label"))
        jumped = stored(jumped, "labels")
        changed = jumped.where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, label, component_id`` per distinct fingerprint of ``doc_id, fp``, a stored table.

    ``label`` is unique per component; ``component_id`` is its smallest document.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    labels = connected(stored(link_fingerprints(distinct, distinct.count(), radius), "simhash-edges"))
    linked = labels.join(distinct, labels["node"] == distinct["fp"]).select("fp", "label", "first_doc")
    least = linked.groupBy("label").agg(F.min("first_doc").alias("least_doc"))
    named = linked.select("fp", "label").join(least, "label").select(F.col("fp").alias("linked_fp"), "label", "least_doc")
    joined = distinct.join(named, F.col("fp") == F.col("linked_fp"), "left")
    own = F.col("linked_fp").isNull()
    return joined.select(
        "fp", F.when(own, F.col("fp")).otherwise(F.col("label")).alias("label"), F.when(own, F.col("first_doc")).otherwise(F.col("least_doc")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, text_key, fp, label, component_id`` per row of ``doc_id, text``; ``text_key`` is a hash of the text."""
    prints = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), fingerprints(F.col("text"), shingle).alias("fp"))
    prints = stored(prints, "simhash-prints")
    # Stored, so that this join stands alone and Spark can split a fingerprint of many rows.
    return prints.join(stored(components(prints, radius), "simhash-components"), "fp").select("doc_id", "text_key", "fp", "label", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that are their component's document with the smallest id; columns unchanged.

    Of several rows with that id, that of the smallest text hash stays, once.
    """
    found = near_duplicates(docs, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("k_null"), F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("text_key").alias("k_text"))
    keepers = found.groupBy("label").agg(F.min(order).alias("k")).select("k.*")
    keys = ["k_null", "k_id", "k_text"]
    while set(keys) & set(docs.columns):  # names of the caller's columns stay free
        keepers, keys = keepers.toDF(*(f"{k}_" for k in keys)), [f"{k}_" for k in keys]
    own = dict(zip(keys, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64(text_or_empty()))))
    return docs.withColumns(own).join(keepers, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
