"""Token files against whole-text encoding, and exact round trips of the coding."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotgrid.llm import token_files
from spotgrid.llm.catalog import QUERIES

tokenizers = pytest.importorskip("tokenizers")
FOLDER = "/root/testdata/sf0.001"


def whole(texts):
    """Ids of whole texts by the library, with the end id."""
    tok = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain_rows(docs):
    """doc_id, start, n_tokens, ids_crc32 in order of doc_id (nulls first), then text."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    rows, start = [], 0
    for (doc_id, _), ids in zip(docs, whole([t for _, t in docs])):
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=70))
def test_numbers_round_trip(values):
    array = np.array(values, dtype=np.uint32)
    control, data = token_files.pack(array)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)
    assert token_files.unpack(control, data, len(values)).tolist() == values
    assert token_files.unpack_block(*token_files.pack_block(array), len(values)).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    got = [np.frombuffer(b, dtype="<u4").tolist() + [1] for b in token_files.load(token_files.default_tokenizer()).encode(texts)]
    assert got == whole(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAeZsS'’.,!?-_:;<|>é́ÉİßΣ1٣%$#`~[](){}/\\ \n日", max_size=12), max_size=6))
def test_marks_and_letters_give_the_ids_of_whole_texts(texts):
    got = [np.frombuffer(b, dtype="<u4").tolist() + [1] for b in token_files.load(token_files.default_tokenizer()).encode(texts)]
    assert got == whole(texts)


@pytest.mark.parametrize("text", ["Don't STOP<|EndOfText|>, x's. été.", "it's  <|endoftext|> 's a<|endoftext|>b", "é ́x", "a b c\x1cd\x85e", "ΣΑΣ ΣΑΣ", "J\u030ca K\u030c. S\u0331AB T\u0308e", "ESTÁ, ÑANDÚ; Größe ÿØ×÷ª", "​ ﻿"])
def test_odd_texts(text):
    got = np.frombuffer(token_files.load(token_files.default_tokenizer()).encode([text])[0], dtype="<u4").tolist() + [1]
    assert got == whole([text])[0]


def test_query_against_whole_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op4_token_files"](spark, FOLDER).collect())
    assert got == sorted(plain_rows(docs))


def test_rows_in_small_blocks(spark, tmp_path):
    docs = [(5, "b a"), (5, "a"), (5, "a"), (None, "x y z"), (2, None), (1, ""), (7, "long word " * 3000)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, part int")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, block_tokens=4)
    starts = {(r["part"], r["block"]): r["block_start"] for r in token_files.block_starts(spark, path).collect()}
    got = [(r["doc_id"], starts[r["part"], r["block"]] + r["before"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in token_files.read_tokens(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain_rows(docs)
    token_files.write_tokens(df.where("false"), path + "-none")
    assert token_files.read_tokens(spark, path + "-none").count() == 0


def test_ranks_count_all_documents(spark, tmp_path):
    # The first blocks hold "a" most often, all documents together hold "b" most often.
    docs = [(i, "a a a b") for i in range(6)] + [(i, "b b b b b c") for i in range(6, 18)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), path, block_tokens=4)
    counts = Counter(x for ids in whole([t for _, t in docs]) for x in ids)
    want = sorted(counts, key=lambda x: (-counts[x], x))
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    assert len(blocks) > 6
    codes = [token_files.unpack(b["control"], b["data"], b["n_tokens"]).tolist() for b in blocks]
    assert [[want[c] for c in block] for block in codes] == whole([t for _, t in docs])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=40))
def test_planes_round_trip(values):
    array = np.array(values, dtype=np.uint32)
    assert token_files.from_planes(token_files.to_planes(array), len(values)).tolist() == values


def test_other_tokenizer_files_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  spaces, CASE and\n\tlines ", "", None, " a a", "don't<|endoftext|> x"]
    tok = tokenizers.Tokenizer.from_file(path)
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in token_files.load(path).encode(texts)] == want
    assert token_files.load(token_files.default_tokenizer()).by_words
