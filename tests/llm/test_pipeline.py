"""The pipeline: each stage on what the one before it kept."""

from collections import Counter

import corpus_pipeline
from spotgrid.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, FOLDER).cache()
        assert after.columns == docs.columns
        kept[name] = after.collect()
        now = after
    given = {r["doc_id"]: r for r in docs.collect()}
    assert all(given[r["doc_id"]] == r for rows in kept.values() for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {d for d, r in given.items() if labels.get(d) == 1 and len(r["text"].split()) >= 50}
    after_quality = {r["doc_id"] for r in kept["quality classifier"]}
    assert len(good - after_quality) <= len(good) // 50
    assert not {d for d, q in labels.items() if q == 0} & after_quality
    prints = [simhash.fingerprint(r["text"]) for r in kept["SimHash near-dedup"]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    mixed = Counter(r["doc_id"] for r in kept["mixing sources to target weights"])
    assert max(mixed.values()) <= 3
    final = corpus_pipeline.STAGES[-1][1](spark, now, FOLDER).collect()
    assert Counter(r["doc_id"] for r in final) == mixed
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) > 0 for r in final)


def test_run_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    text = " ".join(f"word{i} the" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (None, text + " more", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.where("false")):
        now = data
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, FOLDER).cache()
        assert now.count() >= (0 if data is not docs else 1)
