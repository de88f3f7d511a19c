import random

import xxhash
from pyspark.sql import functions as F

from stepforge.llm import simhash
from stepforge.llm.components import components

SCHEMA = "doc_id long, text string, node string, fp string"


def brute(texts):
    prints = []
    for t in texts:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, label))}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(40)) for _ in range(300)) for _ in range(6)]
    texts = [None, "", " \n", "One", "one", "one two", *base]
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rng.randrange(300)] = "x" + str(rng.randrange(9))
            texts.append(" ".join(w))
    texts += [base[0]] * 30 + ["q " * 20000]
    docs = spark.createDataFrame([(i, t, "n", "f") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_links_are_exact_for_dense_fingerprints(spark):
    rng = random.Random(5)
    base = rng.getrandbits(62)
    values = sorted({base ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(60)) for _ in range(120)})
    fps = spark.createDataFrame(list(enumerate(values)), "node long, fp long")
    found = {(r.a, r.b) for r in simhash.links(fps).collect()}
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in found)
    got = {r.node: r.component for r in components(simhash.links(fps)).collect()}
    label = list(range(len(values)))
    for _ in values:
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
    linked = {i for i, x in enumerate(values) if any(i != j and (x ^ y).bit_count() <= 2 for j, y in enumerate(values))}
    assert got == {i: label[i] for i in linked}


def test_every_close_pair_collides():
    masks = simhash.covering_masks(2)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", "", ""), (None, "zz", "", ""), (4, "a b c d", "", ""), (4, "a b c d", "", "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_components_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.where("a < 0")).count() == 0
