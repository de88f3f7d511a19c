import random

import corpus_pipeline as P
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stepforge.llm import near_copies, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_the_stage_drops_near_copies_beyond_two_bits(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows = {}
    for i in range(30):
        base = words(rng.randrange(60, 120))
        rows[100 + i] = " ".join(base)
        for at in rng.sample(range(5, len(base) - 5), 1 + (i >= 15) * 8):  # one word changed: near; nine: not
            base[at] = "changed"
        rows[200 + i] = " ".join(base)
    rows |= {300: "", 301: "a b", 302: "A  b", 303: "a b c d e", 304: "a b c d f"}
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    far = [bin(simhash._fingerprint(rows[100 + i].encode(), 3) ^ simhash._fingerprint(rows[200 + i].encode(), 3)).count("1") for i in range(15)]
    assert sum(x > 2 for x in far) > 5 and all(similarity(rows[100 + i], rows[200 + i]) >= 0.8 for i in range(15))
    near = {(max(a, b), min(a, b)) for a, b in near_copies.links(docs).collect()}
    assert near == {(a, b) for a in rows for b in rows if a > b and rows[a].lower().split() != rows[b].lower().split() and similarity(rows[a], rows[b]) >= 0.8}
    kept = {r.doc_id for r in dict(P.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert set(rows) - kept == {200 + i for i in range(15)} | {302}


def test_a_file_of_several_groups(spark):
    # all texts in one file, in blocks of a few shingles: those unlike the pivot find one another and those like it
    sets = [(10 * g + k, list(range(100 * g, 100 * g + 40)) + [100 * g + 50 + k]) for g in range(12) for k in range(5)]
    sets += [(500, [*range(4, 40), 50, 90, 91]), (501, [*range(8, 40), 50, 90, 91, 92])]  # like a copy of the first group, and like that one only
    members = spark.createDataFrame(sets, "node long, members array<long>")
    filed = spark.createDataFrame([(1, node, float(node == 3), len(m)) for node, m in sets], "g long, node long, w double, n int")
    agree = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    every = [(a, b) for a, x in sets for b, y in sets if a < b and agree(x, y)]
    for block in (100, 1 << 20):
        pairs = [tuple(r) for r in near_copies.resembling(filed, members, members, block=block).collect()]
        assert all((min(p), max(p)) in every for p in pairs) and label([n for n, _ in sets], pairs) == label([n for n, _ in sets], every)


def label(nodes, pairs):
    """The smallest node that each node is joined to."""
    out = {n: n for n in nodes}
    while True:
        before = dict(out)
        for a, b in pairs:
            out[a] = out[b] = min(out[a], out[b])
        if out == before:
            return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 8), min_size=1, max_size=6), min_size=1, max_size=9), st.integers(0, 4), st.randoms())
def test_blocks_join_all_that_their_pairs_join(sets, first, rnd):
    sets = [np.array(sorted(s)) for s in sets]
    like = np.array([rnd.random() < 0.3 for _ in sets])  # one group already
    place = np.array([i if rnd.random() < 0.7 else -1 for i in range(len(sets))])[first:]
    edges = near_copies.joined(sets[first:], sets, like, place, 0.5)
    names = [i if place[i - first] >= 0 else 100 + i for i in range(first, len(sets))]
    group = [(i, j) for i in np.flatnonzero(like) for j in np.flatnonzero(like)]
    agree = lambda a, b: len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))
    every = [(names[i], j) for i, x in enumerate(sets[first:]) for j, y in enumerate(sets) if agree(x, y) and names[i] != j]
    got = [(names[i], j) for i, j in edges]
    assert set(got) <= set(every)
    nodes = {*range(len(sets)), *names}
    assert label(nodes, got + group) == label(nodes, every + group) and len(got) <= 2 * len(sets)


def test_long_texts_common_passages_and_empty_tables(spark):
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    passage, rows = words(80), {}
    for i in range(60):
        rows[i] = passage + words(40)
    for i in range(20):  # one word in 50 changed, or one in 12
        base = words(rng.randrange(300, 700))
        rows[100 + i], copy = base, list(base)
        for at in range(7, len(base), 50 if i < 10 else 12):
            copy[at] = "changed"
        rows[200 + i] = copy
    rows[300], rows[301], rows[302] = rows[100], [], None
    docs = spark.createDataFrame(
        [(i, None if t is None else " ".join(t), "x", "y") for i, t in rows.items()] + [(None, "a b", "x", "y")],
        "doc_id long, text string, node string, members string"
    )
    near = {(max(a, b), min(a, b)) for a, b in near_copies.links(docs).collect()}
    assert near == {(200 + i, 100 + i) for i in range(10)}
    assert near_copies.links(docs.limit(0)).count() == 0


def test_all_links_of_random_groups_are_joined(spark):
    rng = random.Random(8)
    rows = {}
    for g in range(25):
        base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(30, 260))]
        for k in range(rng.randrange(2, 9)):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(0, max(2, len(base) // 30))):
                copy[at] = f"c{rng.randrange(999)}"
            rows[100 * g + k] = " ".join(copy)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")

    same = [(a, b) for a in rows for b in rows if a > b and rows[a] == rows[b]]
    every = [(a, b) for a in rows for b in rows if a > b and a // 100 == b // 100 and similarity(rows[a], rows[b]) >= 0.8]
    found = [tuple(r) for r in near_copies.links(docs).collect()]
    assert all(similarity(rows[a], rows[b]) >= 0.8 for a, b in found)
    groups = label(rows, found + same)
    assert len(every) == 174 and all(groups[a] == groups[b] for a, b in every)


def test_a_large_family_at_the_limit(spark):
    # hundreds of texts changed at a few places each: about 0.7 alike, some 0.8
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for k in range(260):
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(1, 7)):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows[k] = " ".join(copy)
    sets = {k: shingles(t) for k, t in rows.items()}
    every = [(a, b) for a in rows for b in rows if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = [tuple(r) for r in near_copies.links(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()]
    assert {(max(p), min(p)) for p in found} <= set(every) and len(found) < 12 * len(rows) < len(every)
    assert label(rows, found) == label(rows, every)
