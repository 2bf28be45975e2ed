"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotgrid.llm import spelling
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        hits = [v for v in counts if near(w, v)]
        best = min(hits, key=lambda v: (-counts[v], v), default=None)
        forms[w], out[w] = best if best and counts[best] >= 5 * n else None, len(hits)
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return sorted(rows)


def rows_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(docs).items() if len(w) >= 6 and n >= 5}
    assert rows_of(QUERIES["op11_spelling"](spark, FOLDER)) == plain_variants(counts)


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 64])
def test_near_words_in_one_or_several_slices(spark, filter_bytes, monkeypatch):
    draw = random.Random(7)
    words = {"".join(draw.choice("abcä") for _ in range(draw.randint(6, 9))) for _ in range(250)}
    words |= {"x" * n for n in range(60, 70)} | {"x" * 64 + "y", "aabbccdd", "abbccdd", "aabbccd", "aabbccde"}
    counts = {w: 5 ** draw.randint(1, 8) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.variants(frame, filter_bytes=filter_bytes))
    assert got == plain_variants(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_odd_rows(spark):
    long = "k" * 150_000
    rows = [(1, "Schloss schloss SCHLOSS"), (1, "Schloss schloss SCHLOSS"), (None, "schlos schloss " * 3), (2, None), (3, ""), (4, "Äpfelchen äpfelchen " * 5), (5, f"{long} " * 5 + f"{long}k " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(1))
    counted = spelling.count_words(docs)
    want = {w: n for w, n in plain_counts(rows).items() if len(w) >= 6}
    assert {r["word"]: r["n"] for r in counted.collect()} == want
    frequent = {w: n for w, n in want.items() if n >= 5}
    assert rows_of(spelling.variants(counted.where("n >= 5"))) == plain_variants(frequent)
    assert spelling.variants(spelling.count_words(docs.where("false"))).count() == 0
    assert spelling.variants(spelling.count_words(docs).where("n > 1000")).count() == 0


def test_dropped_letters():
    runs = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}stem" for i in range(3000)]
    changed = [r for r in runs if spelling.dropped(12, r) != r]
    assert changed and all(zlib.crc32(f"12:{r}".encode()) % 199 == 0 and len(spelling.dropped(12, r)) == len(r) - 1 for r in changed)


def test_hashes_of_edits_are_those_of_the_edited_words():
    alphabet = np.frombuffer("abcxyz".encode(), dtype=np.uint8)
    words = ["abcabc", "aabbcc", "zzzzzzz"]
    found = {}
    for places, hashes, _, _ in spelling.edits(words, alphabet):
        for p, h in zip(places.tolist(), hashes.tolist()):
            found.setdefault(p, []).append(h)
    for i, w in enumerate(words):
        strings = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abcxyz" if c != w[k]}
        assert sorted(found[i]) == sorted(spelling.word_hashes(sorted(strings)).tolist())
