import random
from collections import defaultdict

from stepforge.llm.packing import best_fit, pack


def whole(rows, capacities):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.offset, r.n_tokens, r.capacity))
        pieces[r.doc_id, r.row].append((r.start, r.n_tokens))
    for inside in bins.values():
        inside.sort()
        at = 0
        for offset, n, _ in inside:
            assert offset == at
            at += n
        assert inside[0][2] == min(c for c in capacities if c >= at)
        assert len({c for *_, c in inside}) == 1
    for p in pieces.values():
        p.sort()
        at = 0
        for start, n in p:
            assert start == at
            at += n
    return bins, {k: sum(n for _, n in v) for k, v in pieces.items()}


def cheapest(lengths, capacities, bin_cost):
    """The least cost of all ways to split a few pieces into bins."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= b) + bin_cost for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= max(capacities):
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_near_the_optimum():
    rng = random.Random(2)
    ratio = []
    for _ in range(40):
        lengths = [rng.randrange(1, 33) for _ in range(7)]
        bins = pack(lengths, (8, 16, 32), 2)
        assert sorted(n for _, b in bins for n in b) == sorted(lengths)
        assert all(sum(b) <= c for c, b in bins)
        ratio.append(sum(c + 2 for c, _ in bins) / cheapest(lengths, (8, 16, 32), 2))
    assert max(ratio) < 1.35 and sum(ratio) / len(ratio) < 1.08


def test_documents(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "w " * 255, "w " * 256, "w\n" * 30000, *["a b c"] * 50, *("x " * rng.randrange(1, 900) for _ in range(300))]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "p q", 1, None), (3, "p", 1, None)], "doc_id long, text string, shard int, row string")
    rows = best_fit(docs, capacities=(64, 256, 512), shard=100).collect()
    bins, sizes = whole(rows, (64, 256, 512))
    assert sorted(sizes.values()) == sorted([len((t or "").split()) + 1 for t in texts] + [3, 2])
    used, held = sum(r.n_tokens for r in rows), sum(v[0][2] for v in bins.values())
    assert used / held > 0.95
    assert len({r.bin_id >> 32 for r in rows}) > 1
    assert best_fit(docs.limit(0)).count() == 0
