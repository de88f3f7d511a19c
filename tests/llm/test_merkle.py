import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stepforge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(nodes, fanout):
    """Root of a list of digests, and for each its siblings level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
            paths[i] += run[: at % fanout] + run[at % fanout + 1 :]
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        places = [at // fanout for at in places]
    return nodes[0], paths


def brute(rows, fanout):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        trees.append((own, *climbed([digest(r) for r in own], fanout)))
    root, over = climbed([t[1] for t in trees], fanout)
    return sorted(repr((r[0], digest(r), sub, root, sha(*path, *up))) for (own, sub, paths), up in zip(trees, over) for r, path in zip(own, paths))


def found(df, fanout):
    out = merkle.manifest(df, fanout=fanout).select("id", "leaf", "subroot", "root", merkle.h(merkle.proof(F.col("path"))), merkle.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    rows = out.collect()
    assert all(r[5] for r in rows)
    return sorted(repr(tuple(r[:5])) for r in rows)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_trees_and_proofs(spark, fanout):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(70)]
    rows += [
        (None, None, None, None, None), (None, "s0", None, None, ""), (5, "é", "x", 1, "long " * 9000), (7, "s0", "en", 7, "same"), (7, "s0", "en", 7, "same"),
        (7, "s0", "en", 7, "other"), (8, "", None, 0, "ß\U0001f600")
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "node", "__at", "path")})
    assert found(df, fanout) == brute(rows, fanout)


def test_one_row_one_group_and_none(spark):
    one = [(1, "a", "en", 1, "x")]
    df = spark.createDataFrame(one, SCHEMA)
    assert found(df, 16) == brute(one, 16)
    assert merkle.manifest(df).first().path == []
    assert merkle.manifest(df.limit(0)).collect() == []
    group = [(i, "a", None, i, str(i)) for i in range(40)]
    assert found(spark.createDataFrame(group, SCHEMA), 16) == brute(group, 16)
    with pytest.raises(ValueError):
        merkle.manifest(df, fanout=1)


def test_a_change_shows_in_its_own_row_only(spark):
    rows = [(i, "a" if i % 3 else None, "en", i, "ABC" if i % 2 else "abc" if i % 4 else None) for i in range(60)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), altered=(hit, {"text": F.lower("text")}))
    got = {r.id: r.ok for r in out.select("id", (merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 5 == 0 and i % 2 == 1) for i in range(60)} and not all(got.values())


def test_a_hot_group_lies_in_many_ranges(spark):
    rows = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
        F.col("id").cast("string").alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = merkle.manifest(rows)
        assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
        leaves = [digest((i, "hot", "en", i, str(i))) for i in range(40_000)]
        assert out.first().root == climbed_root(leaves)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def climbed_root(nodes):
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0]
