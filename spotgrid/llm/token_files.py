"""Token-id files: frequency-ranked ids in byte-aligned codes, control bytes apart from data bytes.

Documents are dealt by ranges of their ids, encoded by the tokenizers library in
ascending order, and held in blocks of whole documents.  Each block counts its
ids; the counts of all blocks, added up, give rank 0 to the most frequent id of
all documents.  A second pass looks the blocks' ids up in this table of ranks and
writes every rank in one to four bytes; two bits per rank in the control bytes say
how many.  It is decoded by looking up each control byte's four lengths in a
table.  A file is a Parquet table with a row per block and one with the ranked ids,
which are at most the tokenizer's vocabulary.

White space never shares a token with a word under the default tokenizer's rules, so
each distinct word of a batch is encoded once and looked up after that; the ids are
those of the whole text.  A tokenizer file with any other rules encodes whole texts.

Rows: a null text counts as empty and has the end id alone; null ids come first;
documents of one id are ordered by text; repeated rows are written each; an empty
table gives an empty file; other columns are ignored.  Memory: one block of
``BLOCK_TOKENS`` ids, or of one longer document, and ``CACHE_WORDS`` cached words.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotgrid.llm.common import SPACE_CHARS, stored
from spotgrid.llm.registry import query, table
from spotgrid.plans.session import shared_folder
from spotgrid.plans.sizing import bounded

END_ID = 1
BLOCK_TOKENS = 1 << 20
CACHE_WORDS = 300_000
#: Bytes of text whose words are looked up together.
PASS_BYTES = 8 << 20
#: Bytes of text per range of ids, and the most ranges there are.
RANGE_BYTES, MOST_RANGES = 32 << 20, 10_000

#: Blocks as the first pass holds them, and as they are written.
HELD_SCHEMA = "part int, block int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, known binary, counts binary, planes binary"
BLOCK_SCHEMA = "part int, block int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, control binary, data binary"
#: Lengths of the four codes of each control byte.
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1).astype(np.int64)
#: Ids below are counted in one array, larger ones by sorting.
COUNTED_IDS = 1 << 22
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def default_tokenizer() -> str:
    """Path of the public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, dtype="<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = lengths - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers behind control and data bytes."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    wide = padded[starts] | padded[starts + 1] << 8 | padded[starts + 2] << 16 | padded[starts + 3] << 24 if n else np.zeros(0, dtype=np.uint32)
    return wide & MASKS[lengths]


def rank_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids by falling frequency (ties by id), their counts, and the rank of each id."""
    if len(ids) and ids.max() >= COUNTED_IDS:
        known, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        return known[order], counts[order], rank[places]
    every = np.bincount(ids)
    known = np.flatnonzero(every)
    known = known[np.argsort(-every[known], kind="stable")]
    rank = np.empty(len(every), dtype=np.uint32)
    rank[known] = np.arange(len(known))
    return known, every[known], rank[ids]


def pack_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A block by itself: its ids by falling frequency (ties by id), and the packed ranks."""
    known, _, ranks = rank_block(ids)
    return known.astype("<u4").tobytes(), *pack(ranks)


def to_planes(values: np.ndarray) -> bytes:
    """The low bytes of unsigned numbers, then the next ones, as far as the largest number reaches."""
    width = 1 + sum(len(values) and int(values.max()) > m for m in (0xFF, 0xFFFF, 0xFFFFFF))
    return np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def from_planes(planes: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers behind planes of bytes."""
    values = np.zeros(n, dtype=np.uint32)
    for i in range(len(planes) // n if n else 0):
        values |= np.frombuffer(planes, dtype=np.uint8, count=n, offset=i * n).astype(np.uint32) << np.uint32(8 * i)
    return values


def unpack_block(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block, by the table of ranks it was packed with."""
    return np.frombuffer(ranks, dtype="<u4")[unpack(control, data, n)]


#: Rules of a tokenizer file under which words may be encoded one by one.
WORD_RULES = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def parts_at_words(rules: dict) -> bool:
    """True if a tokenizer file's rules are :data:`WORD_RULES` and its special tokens lie inside words that are encoded as they are."""
    inside = lambda t: set(t["content"]) & set("<|") and not set(t["content"]) & set(SPACE_CHARS)
    exact = lambda t: not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    added = all(inside(t) and exact(t) for t in rules.get("added_tokens") or [])
    return added and not rules["model"].get("dropout") and all(rules.get(k) == v for k, v in WORD_RULES.items())


def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte that is not a visible character by itself: those from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: 0x100 + i for i, byte in enumerate(b for b in range(0x100) if b not in visible)}


BYTE_ALPHABET = byte_alphabet()


class Lookup(dict):
    """Values worked out when first asked for, in two generations: what is used stays, the rest goes when a generation is full."""

    def __init__(self, make: Callable[[bytes], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """A tokenizer with bounded caches of words, for rules under which white space parts all tokens.

    Files with other rules than :data:`WORD_RULES` encode whole texts.  Under these
    rules a token never joins an ASCII letter with the signs after it, and the case of
    ASCII letters is lost, so a word is looked up as its letters in lower case and its
    closing signs.  Words with digits, apostrophes or the marks of
    special tokens, and those that end otherwise, are encoded as they are.  Units of
    ASCII need no normalisation, and the model segments them directly; so do units of
    ASCII and Latin-1 letters alone, which are composed already, have one lower case
    each and stay in one piece, once their bytes are spelled in the byte alphabet.
    """

    plain = re.compile(rb"([A-Za-z\x80-\xff]*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:;=-@\[-`{}~]*)")
    latin = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = parts_at_words(json.loads(self.tokenizer.to_str()))
        self.words, self.units = Lookup(self._word, CACHE_WORDS), Lookup(self._unit, CACHE_WORDS)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]
        out, known = [], self.words.__getitem__
        for text in texts:
            raw = (text or "").encode()
            # The case of ASCII letters is lost anyway, but for special tokens and letters that a mark behind them composes with.
            words = raw.split() if b"<|" in raw or self._marked(raw) else raw.lower().split()
            out.append(b"".join(map(known, words)))
            self.words.turn()
            self.units.turn()
        return out

    @staticmethod
    def _marked(raw: bytes) -> bool:
        """True if a text may hold combining marks (U+0300 to U+036F)."""
        return b"\xcc" in raw or b"\xcd" in raw

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone
            return self.units[word.lower()]
        match = self.plain.fullmatch(word)
        if not match or self._marked(word):
            return self._whole(word)
        unit, tail = match.groups()
        return self.units[unit.lower()] + self.units[tail] if tail else self.units[unit.lower()]

    def _unit(self, unit: bytes) -> bytes:
        text = unit.decode()
        if not unit.isascii():
            if not self.latin.fullmatch(text):
                return self._whole(unit)
            text = text.lower().encode().decode("latin-1").translate(BYTE_ALPHABET)
        found = [token.id for token in self.model.tokenize(text)]
        return struct.pack(f"<{len(found)}I", *found)

    def _whole(self, word: bytes) -> bytes:
        """A word's ids by all steps of the tokenizer."""
        found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)


@lru_cache(maxsize=4)
def load(path: str) -> WordEncoder:
    """The encoder of a tokenizer file; once per process."""
    return WordEncoder(path)


def _passes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ids and texts with about ``PASS_BYTES`` of text each, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PASS_BYTES, prepend=-1)).tolist()
    for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _block_row(values: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=kinds[t]) for v, t in zip(values, types)], names=names)


def _hold_blocks(path: str, end_id: int, block_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def row(part: int, block: int, ids: list[int | None], encoded: list[bytes]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(encoded), dtype="<u4")
        known, counts, ranks = rank_block(flat)
        held = [known.astype("<u4").tobytes()], [counts.astype("<u4").tobytes()], [to_planes(ranks)]
        return _block_row([[part], [block], [len(flat)], [ids], [[len(e) // 4 for e in encoded]], *held], HELD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load(path), TaskContext.get().partitionId()
        ids, encoded, held, block = [], [], 0, 0
        for batch in batches:
            for some in _passes(batch):
                for doc_id, found in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    ids.append(doc_id)
                    encoded.append(found + end)
                    held += len(found) // 4 + 1
                    if held >= block_tokens:
                        yield row(part, block, ids, encoded)
                        ids, encoded, held, block = [], [], 0, block + 1
        if ids:
            yield row(part, block, ids, encoded)

    return run


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with their counts, over all blocks of a task."""
    ids, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        for known, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            both = np.concatenate((ids, np.frombuffer(known, dtype="<u4"))), np.concatenate((counts, np.frombuffer(n, dtype="<u4")))
            ids, places = np.unique(both[0], return_inverse=True)
            counts = np.zeros(len(ids), dtype=np.int64)
            np.add.at(counts, places, both[1])
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["token_id", "n"])


def _rank_ids(held: DataFrame) -> np.ndarray:
    """All ids of the held blocks by falling frequency (ties by id); as many as the vocabulary has at most."""
    counts = held.select("known", "counts").mapInArrow(_count_ids, "token_id bigint, n bigint")
    rows = counts.groupBy("token_id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["token_id"] for r in sorted(rows, key=lambda r: (-r["n"], r["token_id"]))], dtype="<u4")


def _recode(ranked: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(ranked, dtype="<u4")
        by_id = np.argsort(ids).astype(np.uint32)
        ascending = ids[by_id]
        for batch in batches:
            for i in range(batch.num_rows):
                n, known, planes = (batch.column(c)[i].as_py() for c in (2, 5, 7))
                codes = by_id[np.searchsorted(ascending, np.frombuffer(known, dtype="<u4"))]
                control, data = pack(codes[from_planes(planes, n)])
                yield _block_row([*(c.slice(i, 1) for c in batch.columns[:5]), [control], [data]], BLOCK_SCHEMA)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of ``doc_id, text`` to ``path`` in ascending order of ids."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-size // RANGE_BYTES)))
    ordered = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    held = stored(ordered.mapInArrow(_hold_blocks(tokenizer or default_tokenizer(), end_id, block_tokens), HELD_SCHEMA), "token-blocks")
    ranked = _rank_ids(held).tobytes()
    held.mapInArrow(_recode(ranked), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    docs.sparkSession.createDataFrame([(ranked,)], "ranks binary").coalesce(1).write.parquet(f"{path}/ranks")


def _read_blocks(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                counts = np.array(one["doc_tokens"], dtype=np.int64)
                ids = unpack_block(ranks, one["control"], one["data"], one["n_tokens"])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts) * 4)).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["part"]] * n, pa.int32()), pa.array([one["block"]] * n, pa.int32()), pa.array(np.arange(n), pa.int32()),
                     pa.array(one["doc_ids"], pa.int64()), pa.array(np.cumsum(counts) - counts), binary],
                    names=["part", "block", "place", "doc_id", "before", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``part, block, place, doc_id, before, ids``.

    ``ids`` holds little-endian 32-bit numbers; ``before`` counts the block's ids
    ahead of the document.
    """
    ranks = bytes(spark.read.parquet(f"{path}/ranks").first()["ranks"])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_read_blocks(ranks), "part int, block int, place int, doc_id bigint, before bigint, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, block, block_start``: ids in the whole file ahead of each block.  Reads no ids."""
    index = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_RANGES rows
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inside.join(F.broadcast(parts), "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("block_start"))


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the file: place, number and checksum."""
    path = shared_folder(spark, "token-file")
    write_tokens(table(spark, sf_dir, "documents"), path)
    starts = block_starts(spark, path)
    found = read_tokens(spark, path).select(
        "part", "block", "doc_id", "before", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    placed = found.join(bounded(starts, starts.count(), 24), ["part", "block"])
    return placed.select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
