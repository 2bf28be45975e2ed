"""Piece encoding against a plain search, the library's own lattice, and exact round trips."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotgrid.llm import pieces
from spotgrid.llm.catalog import QUERIES

sentencepiece = pytest.importorskip("sentencepiece")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def plain(model, text):
    """Viterbi over the whole text with a dictionary."""
    table = {p: (s, i) for i, (p, s) in enumerate(zip(model.pieces, scores())) if p}
    text = (" " + text).replace(" ", pieces.SPACE) if text else ""
    best = [(0.0, 0, 0)] + [(float("-inf"), 0, 0)] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 16), j):
            score, piece = table.get(text[i:j], (model.unknown if j - i == 1 else float("-inf"), -1))
            if best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, i, piece)
    out, j = [], len(text)
    while j:
        _, i, piece = best[j]
        out = ([piece] if piece >= 0 else [model.byte_ids[b] for b in text[i:j].encode()]) + out
        j = i
    return out


def scores():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    return [library.get_score(i) for i in range(library.vocab_size())]


def ids(model, text):
    import numpy as np

    return np.frombuffer(model.encode([text])[0], dtype="<i4").tolist()


@pytest.mark.parametrize("text", ["", "a", " ", "  a  b", "The thing is\nnew", "x\n\n y", "größer ñandú 日本 🦜", "<s> </s> <0x41> <unk>", "internationalization " * 3, "\x00\t"])
def test_same_as_plain_search(model, text):
    assert ids(model, text) == plain(model, text)
    assert model.decode(ids(model, text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(model, text):
    assert model.decode(ids(model, text)) == text


def test_mark_in_the_text_comes_back(model):
    for text in ("▁", "a▁b", "▁▁ a", " ▁", "▁ "):
        assert model.decode(ids(model, text)) == text


def test_same_as_the_library_on_a_unigram_reading(model):
    """The library's own lattice over the same pieces, the model's type switched to unigram."""
    raw = open(pieces.default_model(), "rb").read()
    place = [m.start() for m in re.finditer(rb"\x18\x02", raw)][-1]  # model_type of the trainer's settings
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:place] + b"\x18\x01" + raw[place + 2 :])
    for text in ("international", "the quick brown fox", "Thanedble thonti", "größer als das Haus"):
        assert ids(model, text) == library.nbest_encode_as_ids(text, 5)[0]


def test_query_gives_back_every_text(spark):
    rows = QUERIES["op7_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)


def test_rows_nulls_clashes_and_empty_tables(spark, model):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "", None), (3, "a b " * 20000, "y")], "doc_id long, text string, other string")
    got = pieces.encode(docs).collect()
    assert [len(r["ids"]) for r in got][:3] == [0, 0, 0] and [r["other"] for r in got] == ["x", None, None, "y"]
    back = pieces.decode(pieces.encode(docs)).collect()
    assert [r["decoded"] for r in back] == ["", "", "", "a b " * 20000]
    assert pieces.encode(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, ids="other")
