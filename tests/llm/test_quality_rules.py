"""Quality rules against plain counts."""

import re

from pyspark.sql import functions as F

from spotgrid.llm import quality_rules as qr


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in (0, 1, 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "one", "a b c", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z \n", "é🦜 ñ # $$ <b>|&%*", "    x y",
    "a b c d a b c q b c d", " lead and trail ", "the cat sat on the mat and was not there " * 12, "w " * 3000, " ".join(f"w{i % 97}" for i in range(5000)),
]


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    rows = sorted(qr.measure(docs).collect(), key=lambda r: r["doc_id"])
    got = [tuple(r["quality"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows]
    short = [i for i, t in enumerate(TEXTS) if len(t or "") < 20000]
    assert [got[i] for i in short] == [plain(TEXTS[i]) for i in short]
    assert [r["n_words"] for r in rows] == ["mine"] * len(TEXTS)
    for r, g in zip(rows, got):
        assert r["quality"]["base_failed"] == (g[0] < 50 or 100 * g[4] > 50 * g[0])
        assert not (r["quality"]["base_failed"] and r["quality"]["kept"])


def test_table_of_rules_decides(spark):
    words = " ".join(f"word{i} the" for i in range(40))
    docs = spark.createDataFrame([(1, words), (1, words), (2, words + " ###" * 20), (3, None), (4, words.upper())], "doc_id long, text string").withColumn("_quality", F.lit(0))
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
    loose = (qr.Rule("any", "n_symbols", "word_chars", 0, None),)
    assert sorted(r["doc_id"] for r in qr.keep_good(docs, loose).collect()) == [1, 1, 2, 4]
    assert qr.keep_good(docs.where("false")).count() == 0


def test_one_projection_without_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = qr.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)
