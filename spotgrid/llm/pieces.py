"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Texts are cut into words (a run of spaces and what follows, or a line break), and
each distinct word of a batch is segmented once.  Words of equal length advance
together: hashes of all substrings of one length come from prefix hashes and probe
that length's sorted piece keys; the best score of every prefix is a vectorised
maximum over the last piece, whose length is the backpointer.  Ties go to the
longer last piece.  A character without a piece becomes its bytes.

The search finds the segmentation of the highest total score under the model
file's piece scores, which is the unigram reading of a model; for a merge-based
model it is a different segmentation than the library's merges, of the same text.
A "▁" in a text is written as bytes, so that every text comes back exactly.

Rows: a null text counts as empty and has no ids; repeated rows are encoded one by
one; an empty table gives an empty table; other columns pass unchanged, and a
clash with an output name raises.  Memory: a batch of rows, a word cache of
``CACHE_WORDS`` entries and ``PASS_CELLS`` characters per vectorised pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from spotgrid.llm.common import Cache
from spotgrid.llm.registry import query, table

SPACE = "▁"
CACHE_WORDS, PASS_CELLS = 300_000, 50_000
#: Longer words are walked in windows of so many characters; low bits of keys that are looked at first.
WINDOW, MARKS = 1 << 14, 1 << 16
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def default_model() -> str:
    """Path of the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of equal length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
    return x ^ (x >> np.uint64(29))


def _mark(keys: np.ndarray) -> np.ndarray:
    """The bits of keys that are looked up first."""
    return ((keys ^ keys >> np.uint64(32)) & np.uint64(MARKS - 1)).astype(np.int64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, from the empty one on."""
    mixed = _mixed(codes)
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + mixed[:, j]
    return out


class Pieces:
    """Piece table of a model with sorted keys per piece length."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        """``pieces`` by id, with "" for control and byte pieces; ``byte_ids`` by byte."""
        self.pieces, self.byte_ids = pieces, byte_ids
        #: Per length: sorted keys, their ids and scores, and a mark for the low bits of each key.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(p) for p in pieces])
        all_scores = np.array(scores)
        self.unknown = float(all_scores[lengths > 0].min()) - UNKNOWN_PENALTY
        for length in sorted(set(lengths[lengths > 0].tolist())):
            ids = np.flatnonzero(lengths == length)
            keys = _prefix_hashes(_codes([pieces[i] for i in ids], length))[:, -1]
            order = np.argsort(keys)
            if np.any(keys[order][1:] == keys[order][:-1]):
                raise ValueError("two pieces share a hash")
            marks = np.zeros(MARKS, dtype=bool)
            marks[_mark(keys)] = True
            self.by_length[length] = keys[order], ids[order].astype(np.int32), all_scores[ids[order]], marks
        self.longest = max(self.by_length)
        self.spelled = [p.replace(SPACE, " ").encode() for p in pieces]
        for byte, i in enumerate(byte_ids):
            self.spelled[i] = bytes([byte])
        # Code points of all pieces one after the other, to compare what was found with the word.
        self.piece_codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
        self.piece_lengths = lengths
        self.piece_starts = np.cumsum(lengths) - lengths
        crossing = any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.by_words = not crossing
        self.units = re.compile("(?s).+" if crossing else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.cache = Cache(CACHE_WORDS)

    def _hits(self, prefix: np.ndarray, size: int, power: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, id and score of all substrings of one length that are pieces."""
        keys, key_ids, key_scores, marks = self.by_length[size]
        probe = prefix[:, size:] - prefix[:, :-size] * power
        row, start = np.nonzero(marks[_mark(probe)])
        found = probe[row, start]
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        real = keys[at] == found
        at = at[real]
        return row[real], start[real], key_ids[at], key_scores[at]

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best piece ids of words of one length, word after word, and how many each has; -1 - code point for a character without a piece."""
        length = len(words[0])
        codes = _codes(words, length)
        prefix = _prefix_hashes(codes)
        n, power, wide = len(words), np.uint64(1), min(self.longest, length)
        # By end of a piece: column k is the piece that starts at ``end - wide + k``.
        ids = np.full((length + 1, n, wide), -1, dtype=np.int32)
        scores = np.full((length + 1, n, wide), -np.inf)
        scores[1:, :, wide - 1] = self.unknown
        with np.errstate(over="ignore"):
            for size in range(1, wide + 1):
                power = power * _BASE
                if size in self.by_length:
                    row, start, found, score = self._hits(prefix, size, power)
                    ids[start + size, row, wide - size] = found
                    scores[start + size, row, wide - size] = score
        best = np.full((n, wide + length + 1), -np.inf)  # the empty start is column ``wide``
        best[:, wide] = 0
        back = np.zeros((length + 1, n), dtype=np.int32)
        rows = np.arange(n)
        for j in range(1, length + 1):
            total = best[:, j : j + wide] + scores[j]
            chosen = np.argmax(total, axis=1)  # the earliest start first
            best[:, wide + j] = total[rows, chosen]
            back[j] = chosen
        out = np.zeros((n, length), dtype=np.int32)
        counts, place = np.zeros(n, dtype=np.int64), np.full(n, length)
        while len(rows):
            end = place[rows]
            chosen = back[end, rows]
            start = end - wide + chosen
            piece = ids[end, rows, chosen]
            counts[rows] += 1
            out[rows, length - counts[rows]] = np.where(piece < 0, -1 - codes[rows, start].astype(np.int32), piece)
            place[rows] = start
            rows = rows[start > 0]
        flat = out[np.arange(length) >= (length - counts)[:, None]]
        if not np.array_equal(self._codes_of(flat), codes.ravel()):
            raise ValueError("two substrings share a hash")
        return flat, counts

    def _codes_of(self, ids: np.ndarray) -> np.ndarray:
        """Code points that ids spell."""
        known = np.maximum(ids, 0)
        sizes = np.where(ids < 0, 1, self.piece_lengths[known])
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        places = np.repeat(np.where(ids < 0, 0, self.piece_starts[known]), sizes) + inside
        bare = np.repeat(ids, sizes)
        return np.where(bare < 0, -1 - bare, self.piece_codes[places]).astype(np.uint32)

    def segment_long(self, word: str) -> np.ndarray:
        """:meth:`segment` of one long word, in windows that hand on the last scores."""
        codes, length = _codes([word], len(word)), len(word)
        ids, sizes = np.zeros(length + 1, dtype=np.int32), np.zeros(length + 1, dtype=np.uint8 if self.longest < 256 else np.int32)
        best = [-math.inf] * (self.longest - 1) + [0.0]  # of the last ends
        for low in range(0, length, WINDOW):
            high = min(length, low + WINDOW)
            first = max(0, low - self.longest + 1)
            prefix = _prefix_hashes(codes[:, first:high])
            found = [(np.arange(low + 1, high + 1), np.ones(high - low, dtype=np.int64), np.full(high - low, -1), np.full(high - low, self.unknown))]
            power = np.uint64(1)
            with np.errstate(over="ignore"):
                for size in range(1, min(self.longest, high - first) + 1):
                    power = power * _BASE
                    if size in self.by_length:
                        _, start, hit, score = self._hits(prefix, size, power)
                        end = start + first + size
                        new = end > low
                        if size == 1:  # a piece of its own takes the place of the unknown character
                            found[0][2][end[new] - low - 1], found[0][3][end[new] - low - 1] = hit[new], score[new]
                        else:
                            found.append((end[new], np.full(int(new.sum()), size), hit[new], score[new]))
            ends, widths, hits, scores = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-widths, ends))  # the earliest start first
            starts = np.searchsorted(ends[order], np.arange(low + 1, high + 2)).tolist()
            listed_widths, listed_scores = widths[order].tolist(), scores[order].tolist()
            base, chosen = len(best), []
            for j in range(high - low):
                top, at = -math.inf, -1
                for t in range(starts[j], starts[j + 1]):
                    total = best[base + j - listed_widths[t]] + listed_scores[t]
                    if total > top:
                        top, at = total, t
                best.append(top)
                chosen.append(at)
            places = order[chosen]
            ids[low + 1 : high + 1], sizes[low + 1 : high + 1] = hits[places], widths[places]
            best = best[-self.longest :]
        path, place = [], length
        listed = sizes.tolist()
        while place:
            path.append(place)
            place -= listed[place]
        ends = np.array(path[::-1])
        out = np.where(ids[ends] < 0, -1 - codes[0, ends - 1].astype(np.int32), ids[ends]).astype(np.int32)
        if not np.array_equal(self._codes_of(out), codes[0]):
            raise ValueError("two substrings share a hash")
        return out

    def _spell_unknown(self, ids: np.ndarray) -> bytes:
        flat: list[int] = []
        for i in ids.tolist():
            flat += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()]
        return np.array(flat, dtype="<i4").tobytes()

    def learn(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids, as little-endian 32-bit numbers."""
        lengths: dict[int, list[str]] = {}
        for word in words:
            lengths.setdefault(len(word), []).append(word)
        for length, same in lengths.items():
            if length > WINDOW:
                yield from ((word, self._spell_unknown(self.segment_long(word))) for word in same)
                continue
            rows = max(1, PASS_CELLS // length)
            for at in range(0, len(same), rows):
                part = same[at : at + rows]
                ids, counts = self.segment(part)
                ends = np.cumsum(counts)
                packed = ids.astype("<i4").tobytes()
                odd = set(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right").tolist())
                cuts = (4 * ends).tolist()
                low = 0
                for i, (word, high) in enumerate(zip(part, cuts)):
                    yield word, self._spell_unknown(ids[low // 4 : high // 4]) if i in odd else packed[low:high]
                    low = high

    def _units_of(self, text: str | None) -> list[list[str]]:
        """Words of a text, in parts between marks that the text has itself."""
        parts = (text or "").split(SPACE)
        # A mark of the text itself becomes a private character, spelled as bytes below.
        return [self.units.findall((" " * (k == 0) + p).replace(" ", SPACE)) if p or (k == 0 and len(parts) > 1) else [] for k, p in enumerate(parts)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers.

        Most texts have single spaces between words: they are parted at spaces and
        line breaks, a word standing for itself after a space, and for itself after
        a line break if one precedes it.
        """
        plain: dict[int, list[str]] = {}
        marked: dict[int, list[list[str]]] = {}
        for i, text in enumerate(texts):
            if self.by_words and text and SPACE not in text and "  " not in text and text[0] != " ":
                plain[i] = text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")
            else:
                marked[i] = [[w if w == "\n" else SPACE + w for w in units] for units in self._units_of(text)]
        new = self.cache.missing(set().union(*plain.values(), *(units for parts in marked.values() for units in parts)))
        held = self.cache.young
        # Keys: a word after a space; a line break and the word after it; or a mark and a unit as it stands.
        rare = {k: ["\n", k[1:]] if k[0] == "\n" else [k[1:]] for k in new if k and k[0] in "\n" + SPACE}
        held.update((w[1:], ids) for w, ids in self.learn([SPACE + k for k in new if k not in rare]))
        words = dict(self.learn({w for units in rare.values() for w in units if w}))
        held.update((k, b"".join([words[w] for w in units if w])) for k, units in rare.items())
        mark = np.array([self.byte_ids[b] for b in SPACE.encode()], dtype="<i4").tobytes()
        known = held.__getitem__
        out = [b""] * len(texts)
        for i, keys in plain.items():
            out[i] = b"".join(map(known, keys))
        for i, parts in marked.items():
            out[i] = mark.join(b"".join(map(known, units)) for units in parts)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; one leading space goes."""
        spelled = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return spelled.removeprefix(" ")


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The pieces of a model file; once per process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces([model.id_to_piece(i) if plain[i] else "" for i in ids], [model.get_score(i) for i in ids], byte_ids)


def _with(docs: DataFrame, new: dict[str, object]) -> StructType:
    clash = set(new) & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return StructType([*docs.schema.fields, *(StructField(k, v) for k, v in new.items())])


def _ids_array(encoded: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in encoded]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def _decoded_array(model: Pieces, ids: pa.Array) -> pa.Array:
    return pa.array([model.decode(x or []) for x in ids.to_pylist()], type=pa.string())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with an array of ids per text, and the ids' text again if ``decoded`` names a column."""
    path = model or default_model()
    new = {ids: ArrayType(IntegerType())} | ({decoded: StringType()} if decoded else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in _slices(batches):
            found = _ids_array(pieces.encode(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            columns = [*batch.columns, found, *([_decoded_array(pieces, found)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, _with(docs, new))


def decode(docs: DataFrame, model: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids; null ids count as none."""
    path = model or default_model()
    new = {decoded: StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in _slices(batches):
            found = _decoded_array(pieces, batch.column(batch.schema.get_field_index(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, decoded])

    return docs.mapInArrow(run, _with(docs, new))


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: ids, and whether its text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.octet_length("decoded").cast("bigint").alias("decoded_bytes"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
