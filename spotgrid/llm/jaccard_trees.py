"""Documents that share most of their n-word shingles, joined over signature trees.

A document's set holds 64-bit hashes of its distinct shingles; equal sets are one
class.  Classes are linked when ``100 * shared >= least * union``, and this module
returns the components of that graph, exactly:

1. *Samples.*  In the order of hashes, linked sets of sizes a and b share at least
   ``k`` of their first ``size - ceil(least * size) + k`` shingles, for any ``k`` up
   to their overlap.  Each set is represented by such a prefix.
2. *Candidates.*  Sampled shingles are counted over all classes.  A set with too few
   shingles that any other set has is linked with nothing.  Of the others, the
   rarest sampled shingles must hold one in common with each linked set, so sets
   that share one of these are tied to one candidate group.
3. *Trees.*  The whole sets of a candidate group form a signature tree: leaves are
   bitmaps of a set's shingles, nodes combine them by OR and keep the range of
   sizes.  A dual traversal drops pairs of nodes whose greatest possible overlap is
   too small for their sizes.  Leaves that remain are compared exactly.  Nodes that
   are linked already are passed over, so copies never make all their pairs.

A group larger than ``PART_SETS`` sets or ``PART_SHINGLES`` shingles is cut into parts.
Parts are joined for themselves, twice in different cuts; only if that leaves the
group in pieces do all pairs of parts follow, which know what is linked already.

Rows: a null text or one without words has an empty set, linked with nothing; with
fewer words than a shingle the whole sequence is the set's one shingle; null ids
belong to components but do not name them (a component of null ids alone has a null
id); repeated rows are rows of one component; an empty table gives an empty table;
other columns are ignored.  Two shingles or sets with the same 64-bit hash count as
equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotgrid.llm.common import stored
from spotgrid.llm.registry import query, table
from spotgrid.llm.simhash import connected
from spotgrid.plans.sizing import bounded

SHINGLE, LEAST = 4, 85
#: One more sampled shingle for so many of the set: more sampling, fewer candidates.
EXTRA = 4
#: Words whose hashes, and sets whose keys, a task remembers.
CACHE_WORDS, CACHE_SETS = 500_000, 200_000
#: Shingles counted in one group, of candidate sets in one group of trees, and sets and shingles in one part of a group.
COUNTED_SHINGLES, GROUP_SHINGLES, PART_SETS, PART_SHINGLES = 1 << 21, 1 << 20, 4096, 1 << 22
FANOUT = 8
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    """All bits of a number depend on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, worked out when first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a text: ASCII lower case, parted at ASCII white space."""
    listed = (text or "").encode().lower().split()  # both act on ASCII alone
    if not listed:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(words.__getitem__, listed), dtype=np.uint64, count=len(listed))
    wide = min(shingle, len(listed))
    weights = _spread(_WEIGHTS[np.arange(wide) % 4] + np.arange(wide, dtype=np.uint64))
    sums = np.full(len(listed) - wide + 1, wide, dtype=np.uint64)
    for i in range(wide):
        sums += _spread(hashes[i : len(hashes) - wide + 1 + i] * (weights[i] | np.uint64(1)))
    return np.unique(_spread(sums))


def overlap_of(n, least: int = LEAST):
    """Fewest shingles that a set of ``n`` shares with a linked one."""
    return -(-least * n // 100)


def extra(n):
    """How many shared shingles the samples of linked sets are sure to hold, if both had this size."""
    return 1 + n // EXTRA


def sample_size(n, least: int = LEAST):
    """Length of a set's sample."""
    return np.minimum(n, n - overlap_of(n, least) + extra(n))


def sure(n, least: int = LEAST):
    """Sampled shingles that a set shares at least with each linked one, which may be smaller."""
    return np.minimum(extra(overlap_of(n, least)), overlap_of(n, least))


def _key(found: np.ndarray) -> int:
    """Hash of a set, as a signed long."""
    value = xxhash.xxh3_64_intdigest(found.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _rows_of_sets(shingle: int, least: int, whole: bool):
    """``doc_id, n, key, shingles`` per document; shingles (all, or the sample) come once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sizes, keys, packed = [], [], []
                for text in some.column(1).to_pylist():
                    found = shingle_set(text, words, shingle)
                    key = _key(found) if len(found) else None
                    if len(seen) >= CACHE_SETS:
                        seen.clear()
                    new = key is not None and key not in seen
                    seen.add(key)
                    sizes.append(len(found))
                    keys.append(key)
                    packed.append((found if whole else found[: sample_size(len(found), least)]).tobytes() if new else None)
                columns = [some.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "shingles"])

    return run


def document_sets(docs: DataFrame, shingle: int, least: int, whole: bool) -> DataFrame:
    """:func:`_rows_of_sets` over ``doc_id, text``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rows_of_sets(shingle, least, whole), f"doc_id {kind}, n bigint, key bigint, shingles binary")


def _counted(buckets: int):
    """Shingles and how many of a task's sets have them, packed per bucket of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            at = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            tokens, counts, at = tokens[order], counts[order], at[order]
            cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
            spans = list(zip(cuts, [*cuts[1:], len(at)]))
            return pa.RecordBatch.from_arrays(
                [pa.array(at[cuts]), pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in spans], pa.binary())],
                names=["bucket", "tokens", "counts"],
            )

        for batch in batches:
            held += [np.frombuffer(s, dtype=np.uint64) for s in batch.column(0).to_pylist()]
            if sum(map(len, held)) > COUNTED_SHINGLES:
                yield rows()
                held = []
        if held:
            yield rows()

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Shingles of a bucket that more than one set has."""
    tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in rows.column("tokens").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in rows.column("counts").to_pylist()])
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    sums = np.add.reduceat(counts, starts)
    return pa.table({"token": pa.array(tokens[starts][sums > 1].view(np.int64)), "df": pa.array(sums[sums > 1])})


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per set and sampled shingle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            samples = some.column(2).to_pylist()
            sizes = [len(s) // 8 for s in samples]
            tokens = np.frombuffer(b"".join(samples), dtype=np.int64)
            keys, n = (np.repeat(some.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(keys), pa.array(n)], names=["token", "key", "n"])


def candidate_edges(classes: DataFrame, least: int = LEAST) -> DataFrame:
    """Edges ``u, v`` between classes (``key, n, shingles``: the sample) whose components hold all links."""
    total = classes.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    buckets = max(1, -(-int(total) // (8 * COUNTED_SHINGLES)))
    packed = classes.select("shingles").mapInArrow(_counted(buckets), "bucket bigint, tokens binary, counts binary")
    shared = packed.groupBy("bucket").applyInArrow(_shared, "token bigint, df bigint")
    listed = classes.select("key", "n", "shingles").mapInArrow(_listed, "token bigint, key bigint, n bigint")
    known = listed.join(shared, "token")
    in_set = Window.partitionBy("key")
    need = F.ceil(F.lit(least) * F.col("n") / 100)
    certain = F.least(1 + F.floor(need / EXTRA), need)
    ranked = known.select("token", "key", certain.alias("sure"), F.count(F.lit(1)).over(in_set).alias("have"), F.row_number().over(in_set.orderBy("df", "token")).alias("rank"))
    rare = stored(ranked.where(F.col("rank") <= F.col("have") - F.col("sure") + 1).select("token", "key"), "jaccard-rare")
    hubs = rare.groupBy("token").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub <> last").select("token", "hub")
    return rare.join(hubs, "token").where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()


class SignatureTree:
    """Sets as bitmaps under nodes of OR-combined bitmaps and ranges of sizes."""

    def __init__(self, sets: list[np.ndarray], known: list[int] | None = None, least: int = LEAST) -> None:
        """``known`` numbers sets that are linked already alike."""
        self.least = least
        sizes = np.array([len(s) for s in sets])
        bands = np.floor(np.log(sizes) / np.log(100 / least)) if least < 100 else sizes
        self.order = np.lexsort((sizes, [s[0] for s in sets], bands)) if len(sets) > 2 else np.arange(len(sets))
        self.sets = [sets[i] for i in self.order]
        sizes = sizes[self.order]
        words = 1 << max(2, min(8, int(2 * np.median(sizes)).bit_length() - 5))
        bits = np.zeros((len(sets), words), dtype=np.uint64)
        for i, s in enumerate(self.sets):
            marks = np.zeros(64 * words, dtype=bool)
            marks[s & np.uint64(64 * words - 1)] = True
            bits[i] = np.packbits(marks, bitorder="little").view(np.uint64)
        surplus = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, surplus)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, surplus = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at)))
        self.one = [np.full(len(level[1]), i == 0) for i, level in enumerate(self.levels)]
        self.parent = list(range(len(sets)))
        if known is not None:
            first: dict[int, int] = {}
            for i, number in enumerate(known[j] for j in self.order):
                self.parent[i] = first.setdefault(number, i)
        self.compared = 0
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def possible(self, level: int, a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may hold a set linked with one below node ``a``.

        Two sets share at most as many shingles as their bitmaps share bits, and the
        shingles beyond one a bit of the set that has fewer of these.
        """
        bits, low, high, surplus = self.levels[level]
        most = np.bitwise_count(bits[others] & bits[a]).sum(axis=1).astype(np.int64) + np.minimum(surplus[others], surplus[a])
        enough = (100 + self.least) * most >= self.least * (low[others] + low[a])
        return others[enough & (100 * high[others] >= self.least * low[a]) & (100 * high[a] >= self.least * low[others])]

    def _children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))

    def _first(self, level: int, node: int) -> int:
        return node * FANOUT**level

    def _same(self, level: int, a: int, b: int) -> bool:
        """True if all sets below two nodes are linked already."""
        return bool(self.one[level][a] and self.one[level][b]) and self._root(self._first(level, a)) == self._root(self._first(level, b))

    def _compare(self, a: int, b: int) -> None:
        self.compared += 1
        x, y = self.sets[a], self.sets[b]
        shared = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * shared >= self.least * (len(x) + len(y) - shared):
            first, second = self._root(a), self._root(b)
            self.parent[max(first, second)] = min(first, second)
            self.edges.append((int(self.order[a]), int(self.order[b])))

    def _within(self, level: int, node: int) -> None:
        """Links among the sets below a node."""
        if not level:
            return
        children = self._children(level, node)
        for child in children.tolist():
            self._within(level - 1, child)
        for i, child in enumerate(children.tolist()):
            for other in self.possible(level - 1, child, children[i + 1 :]).tolist():
                self._between(level - 1, child, other)
        roots = {self._root(self._first(level - 1, c)) for c in children.tolist()}
        self.one[level][node] = len(roots) == 1 and bool(self.one[level - 1][children].all())

    def _between(self, level: int, a: int, b: int) -> None:
        """Links from the sets below one node to those below another."""
        if self._same(level, a, b):
            return
        if not level:
            self._compare(a, b)
            return
        others = self._children(level, b)
        for child in self._children(level, a).tolist():
            for other in self.possible(level - 1, child, others).tolist():
                self._between(level - 1, child, other)
                if self._same(level, a, b):
                    return

    def links(self) -> list[tuple[int, int]]:
        """Places of linked sets, enough to join all that links join."""
        self._within(len(self.levels) - 1, 0)
        return self.edges


def _link(least: int):
    """Edges within each candidate group of a table ``group, label, part, key, known, shingles``."""

    def link(rows: pa.Table) -> pa.Table:
        labels, parts = rows.column("label").to_numpy(), rows.column("part").to_numpy()
        keys, known = rows.column("key").to_numpy(), rows.column("known").to_numpy()
        sets = rows.column("shingles").to_pylist()
        order = np.lexsort((keys, parts, labels))
        cuts = np.flatnonzero((np.diff(labels[order]) != 0) | (np.diff(parts[order]) != 0)) + 1
        edges: list[tuple[int, int]] = []
        for places in np.split(order, cuts):
            if len(places) > 1:
                tree = SignatureTree([np.frombuffer(sets[i], dtype=np.uint64) for i in places], known[places].tolist(), least)
                edges += [(int(keys[places[a]]), int(keys[places[b]])) for a, b in tree.links()]
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})

    return link


def _linked(sets: DataFrame, part: Column, groups: int, least: int) -> DataFrame:
    """Edges from sets (``label, key, known, shingles``) that meet by label and part."""
    placed = sets.withColumn("part", part).withColumn("group", F.pmod(F.xxhash64("label", "part"), F.lit(groups)))
    return placed.select("group", "label", "part", "key", "known", "shingles").groupBy("group").applyInArrow(_link(least), "u bigint, v bigint")


def _named(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Sets with what is linked so far in ``known``."""
    labels = connected(edges).select(F.col("node").alias("key"), F.col("label").alias("now"))
    return sets.join(labels, "key", "left").withColumn("known", F.coalesce("now", "key")).drop("now")


def links_of_groups(sets: DataFrame, least: int = LEAST, part_sets: int = PART_SETS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Edges ``u, v`` that join all linked sets of each candidate group; a stored table ``label, key, n, shingles``."""
    sizes = stored(sets.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")), "jaccard-groups")
    summed = sizes.agg(F.sum("total"), F.max("members"), F.max("total")).first()
    groups = max(1, -(-(summed[0] or 0) // GROUP_SHINGLES))
    large = sizes.where((F.col("members") > part_sets) | (F.col("total") > part_shingles))
    large = large.select("label", F.greatest(F.ceil(F.col("members") / part_sets), F.ceil(F.col("total") / part_shingles)).alias("parts"))
    fresh = sets.withColumn("known", F.col("key"))
    if (summed[1] or 0) <= part_sets and (summed[2] or 0) <= part_shingles:
        return _linked(fresh, F.lit(0).cast("bigint"), groups, least)
    found = stored(_linked(fresh.join(large, "label", "left_anti"), F.lit(0).cast("bigint"), groups, least), "jaccard-edges")
    cut = stored(fresh.join(F.broadcast(large), "label"), "jaccard-cut")
    edges = None
    for seed in (1, 2):
        own = cut if edges is None else _named(cut, edges)
        some = stored(_linked(own, F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("parts")), groups, least), "jaccard-edges")
        edges = some if edges is None else edges.unionByName(some)
    joined = stored(_named(cut, edges), "jaccard-cut")
    pieces = joined.groupBy("label").agg(F.min("known").alias("least_known"), F.max("known").alias("most_known")).where("least_known <> most_known").select("label")
    split = joined.join(pieces, "label", "left_semi")
    own_part = F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts"))
    paired = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    pair = F.least("other", own_part) * F.col("parts") + F.greatest("other", own_part)
    return found.unionByName(edges).unionByName(_linked(paired, pair, groups, least))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, part_sets: int = PART_SETS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``doc_id, text``."""
    rows = stored(document_sets(docs, shingle, least, False).withColumn("uid", F.monotonically_increasing_id()), "jaccard-samples")
    # A task gives each set once; what other tasks gave again is few rows, which are left out where they lie.
    given = rows.where(F.col("shingles").isNotNull())
    first = given.groupBy("key").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("key", "first")
    again = stored(given.select("key", "uid").join(first, "key").where("uid <> first").select("uid"), "jaccard-again")
    classes = given.join(bounded(again, again.count(), 16), "uid", "left_anti").select("key", "n", "shingles")
    groups = stored(connected(candidate_edges(classes, least)).select(F.col("node").alias("key"), "label"), "jaccard-candidates")
    candidates = bounded(groups, groups.count(), 32)
    whole = document_sets(docs, shingle, least, True).where(F.col("shingles").isNotNull()).select("key", "n", "shingles")
    sets = stored(whole.join(candidates, "key").dropDuplicates(["key"]).select("label", "key", "n", "shingles"), "jaccard-sets")
    labels = connected(links_of_groups(sets, least, part_sets, part_shingles)).select(F.col("node").alias("key"), "label")
    firsts = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_doc")).join(labels, "key", "left")
    firsts = stored(firsts.withColumn("label", F.coalesce("label", "key")), "jaccard-labels")
    least_docs = firsts.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = stored(firsts.join(least_docs, "label").select("key", F.lit(True).alias("has_words"), "component_id"), "jaccard-components")
    out = rows.select("doc_id", "n", "key").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("has_words"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


OP12_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM t
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""


@query("op12_jaccard_trees", OP12_SQL)
def op12_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return near_copies(table(spark, sf_dir, "documents"))
