import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepforge.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Codebooks and (id, label, code, error) by whole loops over Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    size = -(-max(len(r[1]) for r in kept) // parts)
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] + [0] * (parts * max(1, size) - len(r[1])) for r in kept]
    width = max(1, size)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(ints[i], p)) for i in order] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(v, p), books[p])[1] for v in ints]
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, o in zip(ints, own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    coded = [[near(cut(v, p), books[p]) for p in range(parts)] for v in ints]
    return books, sorted(repr((r[0], r[2], "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c))) for r, c in zip(kept, coded))


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"__v": F.lit(1), "code": F.lit("x"), "v": F.lit(0)})
    books = V.train(df, **options)
    want, coded = brute(rows, **options)
    out = V.encode(df, books)
    assert books.entries.tolist() == want
    assert sorted(repr(tuple(r)) for r in out.collect()) == coded
    assert books.digest() == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    whole = {r.code: r.approx for r in V.restored(out, books).collect()}
    assert all(a == [x for p in range(4) for x in want[p][int(c[2 * p : 2 * p + 2], 16)]] for c, a in whole.items())


def test_against_whole_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist() if i % 2 else rng.normal(size=8).tolist(), i % 3) for i in range(90)]
    rows += [(i, [0.5] * 8, None) for i in range(200, 260)]
    check(spark, rows, entries=20)


def test_odd_rows(spark):
    rows = [
        (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf")] * 4, 2), (5, [], None), (6, [-0.25, 1.5, 2.0], 1),
        (None, [1.0] * 5, 2), (6, [9.0, -9.0], 3), (7, [-1e-9], 3)
    ]
    check(spark, rows)
    check(spark, [(1, [], None)])


def test_no_vectors_and_too_large(spark):
    empty = spark.createDataFrame([(1, None, 1)], SCHEMA)
    books = V.train(empty)
    assert V.encode(empty, books).collect() == [] and V.encode(empty.limit(0), V.train(empty.limit(0))).collect() == []
    with pytest.raises(ValueError):
        V.train(spark.createDataFrame([(1, [1e30], 1)], SCHEMA))
    with pytest.raises(ValueError):
        V.train(empty, entries=257)


@settings(max_examples=120, deadline=None)
@given(
    st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), max_size=30),
    st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=9), st.sampled_from([4, 1 << 20])
)
def test_trie_finds_the_nearest(parts, book, largest):
    parts, book = np.array(parts, np.int64).reshape(-1, 3), np.array(book, np.int64)
    index, distance = V.nearest(parts, book, largest)
    for v, i, d in zip(parts, index, distance):
        all_ = ((book - v) ** 2).sum(1)
        assert (i, d) == (all_.argmin(), all_.min())


def test_equal_vectors_share_a_code(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 0.0, 1.0, 2.0], i % 2 or None) for i in range(50)], SCHEMA)
    coded = V.encode(df, V.train(df, entries=3))
    assert coded.select("code").distinct().count() <= 5
    assert coded.groupBy("label").count().count() == 2
