"""Signature trees and the whole join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotgrid.llm import jaccard_trees
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows):
    """``(doc_id, n, component)`` per row of (doc_id, text)."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(draw, words, share):
    return [draw.choice(["x", "y", "z"]) + w if draw.random() < share else w for w in words]


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_jaccard_trees"](spark, FOLDER)) == plain_components(docs)


@pytest.mark.parametrize("part_sets", [5, 4096])
def test_families_in_one_part_or_several(spark, part_sets):
    """Near copies at the threshold's border, chains, passages that many share, odd rows."""
    draw = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(draw.choice([20, 60, 200]))]
        last = base
        for _ in range(9):
            last = edited(draw, last if family % 2 else base, draw.choice([0.0, 0.01, 0.02, 0.05]))
            rows.append((len(rows), " ".join(last + (passage if draw.random() < 0.3 else []))))
    rows += [(len(rows) + i, " ".join(passage + [f"own{i}v{j}" for j in range(draw.randint(0, 30))])) for i in range(12)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three four"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[5][1]), (None, "alone here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine")).withColumn("n", F.lit(1))
    got = jaccard_trees.near_copies(docs, part_sets=part_sets)
    assert rows_of(got) == plain_components(rows)
    assert jaccard_trees.near_copies(docs.where("false")).count() == 0


def test_long_text(spark):
    long = [f"w{i % 50021}" for i in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:190_000])), (3, "word " * 100_000), (4, "x" * 300_000)]
    got = jaccard_trees.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == plain_components(rows)


def test_samples_of_linked_sets_share_what_is_sure():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randint(1, 120)
        base = draw.sample(range(10**6), n)
        other = [x for x in base if draw.random() > 0.07] + draw.sample(range(10**6, 2 * 10**6), draw.randint(0, n // 12))
        a, b = sorted(base), sorted(other)
        shared = len(set(a) & set(b))
        if b and 100 * shared >= 85 * (len(a) + len(b) - shared):
            first, second = (set(s[: jaccard_trees.sample_size(len(s))]) for s in (a, b))
            assert len(first & second) >= max(jaccard_trees.sure(len(a)), jaccard_trees.sure(len(b)))


def test_tree_finds_all_links_and_passes_over_the_rest():
    draw = np.random.default_rng(4)
    sets, family = [], []
    for f in range(40):
        base = draw.integers(0, 2**63, draw.integers(40, 400), dtype=np.uint64)
        for _ in range(8):
            kept = base[draw.random(len(base)) > 0.02]
            sets.append(np.unique(np.concatenate([kept, draw.integers(0, 2**63, 2, dtype=np.uint64)])))
            family.append(f)
    tree = jaccard_trees.SignatureTree(sets)
    edges = tree.links()
    assert tree.compared < 0.05 * len(sets) ** 2 / 2
    parent = list(range(len(sets)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        parent[root(a)] = root(b)
    plain = list(range(len(sets)))

    def other(x):
        return x if plain[x] == x else other(plain[x])

    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                plain[other(i)] = other(j)
    assert len({(root(i), other(i)) for i in range(len(sets))}) == len({root(i) for i in range(len(sets))}) == len({other(i) for i in range(len(sets))})


def test_copies_of_one_set_are_compared_a_few_times_each():
    draw = np.random.default_rng(9)
    base = draw.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.delete(base, draw.integers(0, 200, 2))) for _ in range(1000)]
    tree = jaccard_trees.SignatureTree(sets)
    assert len(tree.links()) == 999 and tree.compared < 10_000
    assert not jaccard_trees.SignatureTree(sets, known=[0] * 1000).links()
