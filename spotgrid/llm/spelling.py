"""Spelling variants: generated edits of every word probe Bloom filters, and only hits meet the vocabulary.

Words of all texts are counted first.  The vocabulary's hashes fill blocked Bloom
filters, one per word length, that are broadcast.  A word's neighbourhood is all its
strings with one code point replaced or deleted (insertions are deletions of the
other word), worked out as hashes only: an edit changes a polynomial hash by one
term.  Edits that the filters let through are joined with the vocabulary by hash,
which removes the false ones, and pairs are compared as strings at last.

The filters take ``FILTER_BYTES`` at most: a larger vocabulary is cut by its hashes
into slices with filters of their own, searched one after the other, with the same
result.

Rows: a null text has no words; a null id counts as empty text in the hash that
decides where a letter is dropped; repeated rows count each; an empty table, or one
without a frequent word, gives an empty table; ties go to the smaller word in
code-point order; other columns are ignored.  Long texts are read as a whole, one
at a time; long words are edited in windows of ``PASS_CELLS`` edits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.llm.common import stored
from spotgrid.llm.registry import query, table

SHORTEST, RAREST, RATIO, DROP_EVERY = 6, 5, 5, 199
#: Words counted in a task before their counts move on; edits per vectorised pass.
HELD_WORDS, PASS_CELLS = 200_000, 1 << 21
#: Words of this many code points or more share one filter.
LONGEST_SHARD = 64
#: All filters of a slice together; 64-bit blocks of a filter per word; bits set per word; blocks built in one group.
FILTER_BYTES, BLOCKS_PER_WORD, BITS, GROUP_BLOCKS = 64 << 20, 0.25, 5, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    """All bits of a number depend on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value per code point that words may hold.
SYMBOLS = _spread(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, one row each."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def _powers(length: int) -> np.ndarray:
    """Weight of each place in a word's polynomial."""
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(length - 1, _BASE))), dtype=np.uint64)[::-1]


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash behind a polynomial's value."""
    return _spread(sums + SYMBOLS[:1] * np.uint64(length))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the places of its words."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    out = np.zeros(len(words), dtype=np.uint64)
    for length, places in _by_length(words):
        rows = max(1, PASS_CELLS // length)
        for at in range(0, len(places), rows):
            some = places[at : at + rows]
            out[some] = _finished(SYMBOLS[_codes([words[i] for i in some])] @ _powers(length), length)
    return out


def dropped(doc_id: int | None, run: str, prefix: int | None = None) -> str:
    """The run, or the run without the code point that its hash with the document names."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()) if prefix is None else prefix)
    if h % DROP_EVERY:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``doc_id, text``: words of ``SHORTEST`` code points or more."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for found, n in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes lower A-Z alone
                    word = dropped(None, found, prefix)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield row()
                    held.clear()
        yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def hashed(counts: DataFrame) -> DataFrame:
    """``word, n, hash, shard`` of ``word, n``; the shard is the length, up to :data:`LONGEST_SHARD`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            shards = np.minimum([len(w) for w in words], LONGEST_SHARD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_hashes(words).view(np.int64)), pa.array(shards, pa.int32())], names=["word", "n", "hash", "shard"])

    return counts.mapInArrow(run, "word string, n bigint, hash bigint, shard int")


def _block(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each hash."""
    bits = np.zeros(hashes.shape, dtype=np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << (hashes >> np.uint64(6 * k) & np.uint64(63))
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), bits


class Filters:
    """A blocked Bloom filter per length."""

    def __init__(self, blocks: dict[int, np.ndarray]) -> None:
        self.blocks = blocks

    def passes(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        """True where a hash may be in the filter of a length."""
        held = self.blocks.get(shard)
        if held is None:
            return np.zeros(hashes.shape, dtype=bool)
        at, bits = _block(hashes, len(held))
        return held[at] & bits == bits


def blocks_of(words: int) -> int:
    """Size of the filter of so many words."""
    return max(1, int(words * BLOCKS_PER_WORD))


def build_filters(vocabulary: DataFrame, sizes: dict[int, int]) -> Filters:
    """Filters of all words; ``sizes`` has the number of words per shard and bounds what reaches the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, shards = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = np.zeros(len(hashes), dtype=np.int64)
            for shard in np.unique(shards).tolist():
                own = shards == shard
                at[own] = _block(hashes[own], blocks_of(sizes[shard]))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at // GROUP_BLOCKS)], names=["hash", "shard", "chunk"])

    def fill(rows: pa.Table) -> pa.Table:
        shard, chunk = rows.column("shard")[0].as_py(), rows.column("chunk")[0].as_py()
        blocks = blocks_of(sizes[shard])
        at, bits = _block(rows.column("hash").to_numpy().view(np.uint64), blocks)
        held = np.zeros(min(GROUP_BLOCKS, blocks - chunk * GROUP_BLOCKS), dtype=np.uint64)
        np.bitwise_or.at(held, at - chunk * GROUP_BLOCKS, bits)
        return pa.table({"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "bits": pa.array([held.tobytes()], pa.binary())})

    placed = vocabulary.select("hash", "shard").mapInArrow(place, "hash bigint, shard int, chunk bigint")
    out = {shard: np.zeros(blocks_of(n), dtype=np.uint64) for shard, n in sizes.items()}
    for r in placed.groupBy("shard", "chunk").applyInArrow(fill, "shard int, chunk bigint, bits binary").collect():
        part = np.frombuffer(r["bits"], dtype=np.uint64)
        out[r["shard"]][r["chunk"] * GROUP_BLOCKS :][: len(part)] = part
    return Filters(out)


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Edits of words in passes: place of the word, hash of the edit, its shard, and whether a code point was deleted.

    Deleting any of several equal neighbours gives one string, which comes once.
    """
    for length, places in _by_length(words):
        powers = _powers(length)
        window = max(1, PASS_CELLS // len(alphabet))
        rows = max(1, PASS_CELLS // (len(alphabet) * min(length, window)))
        for at in range(0, len(places), rows):
            some = places[at : at + rows]
            codes = _codes([words[i] for i in some])
            symbols = SYMBOLS[codes]
            whole = symbols @ powers
            if length > 1:
                first = np.ones(codes.shape, dtype=bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                # What stands before the gap moves one place down.
                before = np.zeros_like(symbols)
                before[:, 1:] = np.cumsum(symbols[:, :-1] * powers[1:], axis=1, dtype=np.uint64)
                behind = whole[:, None] - np.cumsum(symbols * powers, axis=1, dtype=np.uint64)
                row, gap = np.nonzero(first)
                yield some[row], _finished((before + behind)[row, gap], length - 1), min(length - 1, LONGEST_SHARD), True
            for start in range(0, length, window):
                part = slice(start, start + window)
                changed = whole[:, None, None] + (SYMBOLS[alphabet] - symbols[:, part, None]) * powers[part, None]
                row, place, letter = np.nonzero(codes[:, part, None] != alphabet)
                yield some[row], _finished(changed[row, place, letter], length), min(length, LONGEST_SHARD), False


def _probe(alphabet: np.ndarray, shared, number: int, slices: int):
    """Edits that a slice's filters let through: hash of the edit, hash of the word, whether a deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            words, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for places, found, shard, deletion in edits(words, alphabet):
                passed = filters.passes(found, shard)
                if slices > 1:
                    passed &= found.view(np.int64) % slices == number
                hits = np.flatnonzero(passed)
                columns = [pa.array(found[hits].view(np.int64)), pa.array(hashes[places[hits]]), pa.array(np.full(len(hits), deletion))]
                yield pa.RecordBatch.from_arrays(columns, names=["edit", "of", "deletion"])

    return run


def one_edit(a: str, b: str) -> bool:
    """True if two words differ by one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same, end = 0, len(a)
    while same < end:  # the longest common start
        middle = (same + end + 1) // 2
        same, end = (middle, end) if a[same:middle] == b[same:middle] else (same, middle - 1)
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words, whose hashes say that they are one edit apart, that are."""
    for batch in batches:
        yield batch.filter(pa.array(list(map(one_edit, batch.column(0).to_pylist(), batch.column(2).to_pylist())), pa.bool_()))


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, word_n, near, near_n``: every two words that differ by one inserted, deleted or replaced code point, both ways.

    ``vocabulary`` is a stored table as of :func:`hashed` with distinct words.
    """
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()  # 190 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), dtype=np.uint8)
    if not len(alphabet):
        return vocabulary.select("word", F.col("n").alias("word_n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    total = vocabulary.count()
    slices = max(1, -(-int(total * 8 * BLOCKS_PER_WORD) // filter_bytes))
    hits = []
    for number in range(slices):
        own = vocabulary
        if slices > 1:
            own = vocabulary.where(F.pmod("hash", F.lit(slices)) == number)
        sizes = {r["shard"]: r["words"] for r in own.groupBy("shard").agg(F.count(F.lit(1)).alias("words")).collect()}
        shared = spark.sparkContext.broadcast(build_filters(own, sizes))
        probed = vocabulary.select("word", "hash").mapInArrow(_probe(alphabet, shared, number, slices), "edit bigint, of bigint, deletion boolean")
        hits.append(stored(probed, "edits") if slices > 1 else probed)
        if slices > 1:
            shared.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    true = stored(every.join(vocabulary.select(F.col("hash").alias("edit")), "edit", "left_semi"), "near-hashes")
    back = true.where("deletion").select(F.col("of").alias("edit"), F.col("edit").alias("of"))
    pairs = true.select("edit", "of").unionByName(back).distinct()
    left = vocabulary.select(F.col("hash").alias("of"), "word", F.col("n").alias("word_n"))
    right = vocabulary.select(F.col("hash").alias("edit"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    named = pairs.join(left, "of").join(right, "edit").select("word", "word_n", "near", "near_n")
    return named.mapInArrow(_exact, named.schema)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms followed to the last one.

    Each round doubles the steps; a form is several times as frequent as its word,
    so there are few.
    """
    links = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nexts = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        links = stored(nexts, "roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``word, n`` with distinct words."""
    vocabulary = stored(hashed(counts.select("word", "n")), "vocabulary")
    pairs = near_pairs(vocabulary, filter_bytes)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    groups = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("near_count"), F.max("word_n").alias("word_n"), best.alias("best"))
    strong = -F.col("best.minus") >= ratio * F.col("word_n")
    found = groups.select("word", "near_count", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    found = stored(found, "forms")
    followed = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    rows = vocabulary.select("word", "n").join(found, "word", "left").join(followed, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("near_count", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of all documents."""
    return variants(count_words(table(spark, sf_dir, "documents")).where(F.col("n") >= RAREST))
