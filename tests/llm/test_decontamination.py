import random
import time

import numpy as np

from stepforge.llm.decontamination import contaminated, tile, without_contaminated

DOCS = "doc_id long, text string, item_id string, h1 string"


def brute(doc, item, seed):
    """Greedy string tiling as first published: rescan for the longest unmarked match."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (seed - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not md[d + n] and not mi[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < seed:
            return tiles
        tiles.append((d, i, n))
        for j in range(n):
            md[d + j] = mi[i + j] = True


def shared(doc, item, seed):
    """The places of each seed that both hold."""
    of = lambda words, s: np.array([at for at in range(len(words) - seed + 1) if words[at : at + seed] == s])
    seeds = sorted({tuple(item[i : i + seed]) for i in range(len(item) - seed + 1)})
    return [(of(doc, list(s)), of(item, list(s))) for s in seeds if len(of(doc, list(s)))]


def test_tile_against_rescanning():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randrange(3, 25))]
        doc = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        at = rng.randrange(len(doc) + 1)
        doc[at:at] = item[len(item) // 2 :] + ["z"] * rng.randrange(2) + item[: len(item) // 2]
        assert tile(shared(doc, item, 3), 3) == brute(doc, item, 3)


def test_documents(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [text(30) for _ in range(5)]
    items += ["too short", None, items[0]]
    halves = items[1].split()
    docs = [
        None, "", items[0], text(200), f"{text(90)} {items[1].upper()}\n{text(20)}", " ".join(halves[15:] + ["x"] + halves[:15]), " ".join(items[2].split()[:15]),
        " ".join(items[2].split()[:20]) + " " + text(4000), f"{items[3]} {items[3]} {items[4]}", "a " * 3000,
    ]
    got = contaminated(
        spark.createDataFrame([(i, d, "x", "y") for i, d in enumerate(docs)], DOCS),
        spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)], "item_id long, text string, d string")
    )
    found = {(r.doc_id, r.item_id): (r.covered_words, r.coverage) for r in got.collect()}
    assert set(found) == {(2, 0), (2, 7), (4, 1), (5, 1), (7, 2), (8, 3), (8, 4)}
    for (d, i), (covered, _) in found.items():
        assert covered == sum(n for *_, n in brute(docs[d].lower().split()[:300], items[i].lower().split(), 5))


def test_removal_keeps_clean_rows_and_columns(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, "a", "b"), (1, "clean", "a", "b"), (None, item, "a", "b"), (None, None, "a", "b"), (2, "x", None, None), (2, "x", None, None)], DOCS)
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "clean"), (2, "x"), (2, "x")]
    assert without_contaminated(docs.limit(0), items).count() == 0
    assert without_contaminated(docs, items.limit(0)).count() == 6


def test_repeated_words_copies_and_common_lines(spark):
    rng = random.Random(9)
    began = time.monotonic()
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    line = text(12)
    items = ["na " * 400, text(60), *[f"{line} {text(24)}" for _ in range(40)]]
    docs = [(0, "na " * 20_000), (1, "na " * 200)]
    docs += [(10 + i, items[1]) for i in range(20_000)]
    docs += [(30_000 + i, f"{line} {text(30)}") for i in range(500)] + [(40_000, items[7]), (40_001, text(30) + " " + items[8])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.coverage for r in got.collect()}
    assert found == {(0, 0): 1.0, **{(10 + i, 1): 1.0 for i in range(20_000)}, (40_000, 7): 1.0, (40_001, 8): 1.0}
    assert time.monotonic() - began < 60


def test_random_texts_of_few_words_against_brute_force(spark):
    rng = random.Random(12)
    text = lambda n: [rng.choice("abcde") for _ in range(n)]
    items = [text(rng.randrange(5, 30)) for _ in range(12)]
    docs = [text(rng.randrange(60)) for _ in range(60)]
    for d in docs[::3]:
        whole = rng.choice(items)
        at = rng.randrange(len(d) + 1)
        d[at:at] = whole[rng.randrange(3) : rng.randrange(8, 30)]
    got = contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    )
    found = {(r.doc_id, r.item_id): (r.n_tiles, r.longest_tile, r.covered_words) for r in got.collect()}
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            sizes = [n for *_, n in brute(doc, item, 5)]
            if sizes and sum(sizes) >= 0.6 * len(item):
                want[d, i] = (len(sizes), max(sizes), sum(sizes))
    assert found == want and len(want) > 10
