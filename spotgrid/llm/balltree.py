"""Exact top-k inner products: ball trees searched by branch and bound, one tree per shard.

Candidates are dealt by hash into shards of about ``SHARD_ROWS`` vectors, and each
shard becomes one packed ball tree.  Queries travel in packed blocks.  A block
first searches one shard; the k-th score it finds there goes with it to all other
shards, where whole subtrees are dropped whose bound (inner product with the
centre plus norm times radius) stays below it.  Within a tree a query visits its
leaves by falling bound and stops at the first one below its current k-th score.
Work meets on (shard, block), so a task holds one tree and one block.

Rows: vectors that are null or hold a null, NaN or infinite component take no part;
shorter vectors are filled up with zeros; rows that share a query's id are its own
and are no candidates for it; ties go to the smaller id, and equal rows each count;
a null id is no query and no candidate; an empty table gives an empty table; other
columns are ignored.  Scores beyond a long are reported as the nearest long.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotgrid.llm.common import stored
from spotgrid.llm.registry import query, table

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 128
#: Whole numbers up to here are exact in a double.
EXACT = 2.0**53
LOW, HIGH = -(2**63), 2**63 - 1


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _stacked(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


@dataclass
class BallTree:
    """Vectors in leaf order, and nodes with centre, radius, children (-1 for a leaf) and row range."""

    vectors: np.ndarray
    ids: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    ranges: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        """Split by the direction between two far vectors, at the median, down to leaves."""
        order = np.arange(len(vectors))
        centers, radii, children, ranges = [], [], [], []

        def grow(low: int, high: int) -> int:
            rows = vectors[order[low:high]]
            center = rows.mean(axis=0)
            away = np.sqrt(((rows - center) ** 2).sum(axis=1))
            node = len(centers)
            centers.append(center)
            radii.append(away.max() * (1 + 1e-9) + 1e-9)
            children.append((-1, -1))
            ranges.append((low, high))
            if high - low > leaf_rows and away.max() > 0:
                first = rows[np.argmax(away)]
                far = rows[np.argmax(((rows - first) ** 2).sum(axis=1))]
                by = np.argsort(rows @ (far - first), kind="stable")
                order[low:high] = order[low:high][by]
                middle = (low + high) // 2
                children[node] = (grow(low, middle), grow(middle, high))
            return node

        grow(0, len(vectors))
        return cls(vectors[order], ids[order], np.array(centers), np.array(radii), np.array(children), np.array(ranges))

    def to_bytes(self) -> bytes:
        """For one row of a table."""
        return _packed(**self.__dict__)

    @classmethod
    def from_bytes(cls, data: bytes) -> BallTree:
        """Back from :meth:`to_bytes`."""
        with np.load(io.BytesIO(data)) as held:
            return cls(**{k: held[k] for k in held.files})

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query place, id and score of hits not below ``floors`` that hold each query's best ``k`` here.

        Rows whose id is the query's ``own`` are left out.
        """
        width = max(queries.shape[1], self.vectors.shape[1])
        queries, vectors, centers = _widened(queries, width), _widened(self.vectors, width), _widened(self.centers, width)
        norms = np.sqrt((queries**2).sum(axis=1))
        kth = floors.copy()
        # Level by level: pairs of query and node whose bound reaches the query's k-th score.
        at_query, at_node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        leaf_query, leaf_node, leaf_bound = [], [], []
        slack = 1 + 1e-9
        while len(at_query):
            bound = np.einsum("ij,ij->i", queries[at_query], centers[at_node]) + norms[at_query] * self.radii[at_node]
            bound += np.abs(bound) * (slack - 1) + 1e-6
            alive = bound >= kth[at_query]
            at_query, at_node, bound = at_query[alive], at_node[alive], bound[alive]
            leaf = self.children[at_node, 0] < 0
            leaf_query.append(at_query[leaf])
            leaf_node.append(at_node[leaf])
            leaf_bound.append(bound[leaf])
            at_query, at_node = np.repeat(at_query[~leaf], 2), self.children[at_node[~leaf]].ravel()
        if not leaf_query:
            return np.zeros(0, dtype=np.int64), self.ids[:0], np.zeros(0)
        qs, nodes, bounds = map(np.concatenate, (leaf_query, leaf_node, leaf_bound))
        order = np.lexsort((-bounds, qs))
        qs, nodes, bounds = qs[order], nodes[order], bounds[order]
        turn = np.arange(len(qs)) - np.searchsorted(qs, qs)
        best = np.full((len(queries), k), -np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_turn = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by_turn], np.arange(turn.max(initial=-1) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = by_turn[a:b]
            now = now[bounds[now] >= kth[qs[now]]]
            for node in np.unique(nodes[now]):
                who = qs[now[nodes[now] == node]]
                low, high = self.ranges[node]
                scores = _products(queries[who], vectors[low:high])
                usable = (self.ids[low:high][None, :] != own[who][:, None]) & (scores >= kth[who][:, None])
                if scores.dtype != object:
                    merged = np.concatenate([best[who], np.where(usable, scores, -np.inf)], axis=1)
                    best[who] = -np.partition(-merged, k - 1, axis=1)[:, :k]
                    kth[who] = np.maximum(kth[who], best[who].min(axis=1))
                    usable &= scores >= kth[who][:, None]
                q, c = np.nonzero(usable)
                hits.append((who[q], self.ids[low:high][c], scores[q, c]))
        if not hits:
            return np.zeros(0, dtype=np.int64), self.ids[:0], np.zeros(0)
        q, ids, scores = (np.concatenate(x) for x in zip(*hits))
        keep = scores >= kth[q] if scores.dtype != object else np.ones(len(q), dtype=bool)
        return _best(q[keep], ids[keep], scores[keep], k)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors; Python's integers where doubles would round."""
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1]) < EXACT:
        return queries @ vectors.T
    exact = [[int(x) for x in row] for row in queries.tolist()], [[int(x) for x in row] for row in vectors.tolist()]
    return np.array([[sum(a * b for a, b in zip(q, v)) for v in exact[1]] for q in exact[0]], dtype=object).reshape(len(queries), len(vectors))


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the first ``k`` by falling score, then id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], ids[first], scores[first]


def whole_vectors(column: str, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` per component as doubles; null for a vector that takes no part."""
    doubles = F.col(column).cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(doubles.isNotNull() & ~bad, F.transform(doubles, lambda x: _floor(x * scale)))


def _floor(x: Column) -> Column:
    """Floor as a double, also beyond longs, where every double is whole already."""
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)


def _build(leaf_rows: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        tree = BallTree.build(_stacked(rows["vector"]), rows["vec_id"].to_numpy(), leaf_rows)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "tree": [tree.to_bytes()]})

    return build


def _pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id"])
    packed = _packed(ids=rows["vec_id"].to_numpy(), vectors=_stacked(rows["vector"]), floors=np.full(len(rows), -np.inf))
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "queries": [packed]})


HITS = "query_id bigint, place int, vec_id bigint, exact string, block bigint, queries binary"


def _search(k: int, pass_on: bool):
    """Hits of one block in one tree; with ``pass_on`` also the block with its k-th scores."""

    def search(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in HITS.split(", ")]
        out = []
        for tree in map(BallTree.from_bytes, trees["tree"]):
            for block, data in zip(blocks["block"], blocks["queries"]):
                with np.load(io.BytesIO(data)) as held:
                    ids, vectors, floors = held["ids"], held["vectors"], held["floors"]
                q, found, scores = tree.search(vectors, ids, k, floors)
                out.append(pd.DataFrame({"query_id": ids[q], "place": q.astype(np.int32), "vec_id": found, "exact": [str(int(s)) for s in scores]}))
                if pass_on:
                    full = np.bincount(q, minlength=len(ids)) >= k
                    lowest = np.full(len(ids), np.inf)
                    np.minimum.at(lowest, q, np.array([float(s) for s in scores]))
                    # A double below the exact score, should it round.
                    kth = np.where(full, lowest - np.where(np.abs(lowest) < EXACT, 0, np.abs(lowest) * 1e-9), -np.inf)
                    out.append(pd.DataFrame({"block": [block], "queries": [_packed(ids=ids, vectors=vectors, floors=kth)]}))
        return pd.concat([pd.DataFrame(columns=columns), *out]).astype({"query_id": "Int64", "place": "Int32", "vec_id": "Int64", "block": "Int64"})[columns] if out else pd.DataFrame(columns=columns)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of whole-number ``vectors`` (``vec_id, vector``); queries are the rows with ``is_query``.

    Rows with a null id or vector take no part.  Every query meets every shard, but
    in a shard only the leaves that can still matter.
    """
    usable = stored(vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select("vec_id", "vector"), "vectors")
    n = usable.count()
    shards = max(1, -(-n // shard_rows))
    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)))
    trees = stored(dealt.groupBy("shard").applyInPandas(_build(leaf_rows), "shard bigint, tree binary"), "ball-trees")
    queries = usable.where(is_query)
    blocks = max(1, -(-queries.count() // block_rows))
    in_blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packed = in_blocks.groupBy("block").applyInPandas(_pack_queries, "block bigint, queries binary")
    home = F.pmod(F.col("block"), F.lit(shards))

    def searched(blocks_at: DataFrame, pass_on: bool) -> DataFrame:
        """One group per (shard, block): the block, and the shard's tree once per block."""
        keys = blocks_at.select(F.col("shard").alias("shard"), F.col("block").alias("block"))
        trees_at = keys.join(trees, "shard").select(F.col("shard").alias("shard"), F.col("block").alias("block"), "tree")
        return trees_at.groupBy("shard", "block").cogroup(blocks_at.groupBy("shard", "block")).applyInPandas(_search(k, pass_on), HITS)

    first = stored(searched(packed.withColumn("shard", home), True), "top-first")
    seeded = first.where(F.col("queries").isNotNull()).select("block", "queries")
    others = seeded.select("block", "queries", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard")).where(F.col("shard") != home)
    hits = first.where(F.col("query_id").isNotNull()).unionByName(searched(others, False)) if shards > 1 else first.where(F.col("query_id").isNotNull())
    score = F.col("exact").cast("decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(score.desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    clipped = F.least(F.greatest(score, F.lit(LOW).cast("decimal(38,0)")), F.lit(HIGH).cast("decimal(38,0)"))
    return ranked.select("query_id", "rank", "vec_id", clipped.cast("bigint").alias("score"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op8_ball_tree", OP8_SQL)
def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every query, all vectors against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole_vectors("embedding").alias("vector"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)
