"""The classifier: marginals against enumeration, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from spotgrid.llm import quality_crf as crf
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_marginals_equal_a_sum_over_all_labellings():
    draw = np.random.default_rng(1)
    n_lines = np.array([3, 1, 5])
    unary, trans = draw.normal(size=9), draw.normal(size=(2, 2))
    chains = crf.Chains(n_lines)
    forward, backward, norm = chains.forward_backward(unary, trans)
    good = np.exp(forward[:, 1] + backward[:, 1] - norm[chains.text_of])
    for first, n in zip(chains.firsts, n_lines):
        total, each = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(unary[first + i] for i in range(n) if labels[i]) + sum(trans[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            each += weight * np.array(labels)
        assert good[first : first + n] == pytest.approx(each / total)


def test_features_see_neighbours():
    features, n_lines, lengths = crf.featurize(["aa bb\n\ncc", None, "x"])
    assert n_lines.tolist() == [2, 1, 1] and lengths.tolist() == [6, 3, 1, 2]
    own = crf.OWN_FEATURES
    assert (features[0, own : 2 * own + 1] == 0).all() and (features[1, own : 2 * own] == features[0, :own]).all() and features[1, 2 * own] == 1
    assert (features[0, 2 * own + 1 : -1] == features[1, :own]).all() and (features[1, 2 * own + 1 :] == 0).all()


def test_held_out_accuracy_and_contract(spark):
    rows = QUERIES["op5_quality_classifier"](spark, FOLDER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97
    good = [r["score"] for r in held if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in held if labels[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"line {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 != 0)) for i in range(60)], "doc_id long, quality int")
    assert crf.train(docs, labels).constant == pytest.approx((n := sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60)), (n + 1) / (n + 2))[1])


def test_rows_nulls_repeats_long_texts_and_empty_tables(spark):
    texts = ["good line of the text\nand more of it", "%%% ### %%%\n%%% ### %%%", None, "", " \n ", "z\n" * 30000, "one " * 40000]
    docs = spark.createDataFrame([(i % 6, t, 0.5) for i, t in enumerate(texts * 2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (2, None), (3, 1), (4, 1)], "doc_id long, quality int")
    model = crf.train(docs, labels)
    scored = docs.select("text", crf.score_texts(model, docs["text"]).alias("s")).collect()
    assert len(scored) == 14 and all(0 <= r["s"] <= 1 for r in scored)
    by_text = {}
    for r in scored:
        by_text.setdefault(r["text"], []).append(r["s"])
    assert by_text[None][0] == pytest.approx(by_text[""][0]) and all(max(v) == pytest.approx(min(v)) for v in by_text.values())
    assert crf.keep_good(docs, labels).columns == docs.columns
    assert crf.keep_good(docs.where("false"), labels).count() == 0
    assert crf.train(docs, labels.where("false")).constant == 0.5
