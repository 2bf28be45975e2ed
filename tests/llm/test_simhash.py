"""Near-duplicates against a brute-force version."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from spotgrid.llm import simhash
from spotgrid.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, per row of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc, _) in enumerate(prints):
        ids.setdefault(root(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((doc, fp, least[root(i)]) for i, (doc, fp) in enumerate(prints)), key=repr)


def test_query_against_brute_force(spark):
    got = QUERIES["op3_simhash"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs])
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got), key=repr) == want
    assert all(len(r["fingerprint"]) == 16 for r in got)


def test_nulls_empty_texts_ties_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(70000))
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A B C D"), (9, None), (8, ""), (7, " \n\t"), (None, "x"), (None, None), (2, "x y"), (1, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("k_id", F.lit(1))
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect()) == [(1, long), (2, "x y"), (3, "A B C D"), (7, " \n\t")]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["x"]
    nothing = simhash.near_duplicates(docs.where("false"))
    assert nothing.count() == 0 and simhash.keep_one(docs.where("false")).count() == 0


@pytest.mark.parametrize("tree_rows", [4, 2048])
def test_links_of_hot_shards(spark, tree_rows):
    """Many fingerprints close together, cut into several trees, in small groups."""
    draw = random.Random(3)
    base = draw.getrandbits(64)
    prints = {base}
    while len(prints) < 60:
        prints.add(draw.choice(sorted(prints)) ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 5))) & (2**64 - 1))
    prints |= {draw.getrandbits(64) for _ in range(40)}
    ordered = sorted(prints)
    signed = [(p - 2**64 if p >> 63 else p,) for p in ordered]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.link_fingerprints(df, len(signed), tree_rows=tree_rows, group_rows=16)
    labels = {r["node"]: r["label"] for r in simhash.connected(edges).collect()}
    want = {}
    for doc, _, least in plain_components([(i, p) for i, p in enumerate(ordered)]):
        want.setdefault(least, set()).add(doc)
    found = {}
    for i, (s,) in enumerate(signed):
        found.setdefault(labels.get(s, s), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_bk_tree_finds_what_a_scan_finds():
    draw = random.Random(1)
    values = [draw.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (q ^ v).bit_count() <= 3]
