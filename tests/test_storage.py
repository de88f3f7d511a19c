"""Intermediate tables: written to the shared folder, deleted when asked."""

import os

import pytest
from pyspark.sql import functions as F

from stepforge.operators import models, programs, storage, summary


def there(df):
    return os.path.isdir(df.staged_path.removeprefix("file://"))


def test_tables_are_deleted_with_their_scratch(spark):
    outside = storage.staged(spark.range(3), "outside")
    with storage.scratch(spark) as keep:
        inside, kept = storage.staged(spark.range(5), "inside"), keep(storage.staged(spark.range(4), "kept"))
        assert there(inside) and inside.count() == 5
        got = summary.freq(inside, "id").collect()
    assert len(got) == 5 and not there(inside) and there(outside) and outside.count() == 3
    assert there(kept)
    storage.drop(outside, spark.range(1), outside, kept)
    assert not there(outside) and not there(kept)
    with pytest.raises(RuntimeError), storage.scratch(spark):
        lost = storage.staged(spark.range(2), "lost")
        raise RuntimeError
    assert not there(lost)


def test_rounds_delete_what_they_have_read(spark):
    chain = spark.range(12).select(F.lit(1).alias("id"), F.concat(F.lit("d"), "id").alias("src"), F.concat(F.lit("d"), F.col("id") + 1).alias("dst"))
    with storage.scratch(spark):
        before = len(storage._written)
        assert {r.depth for r in programs.dependency_depth(chain).collect()} == set(range(13))
        assert len([p for p in storage._written[before:] if "/steps-" in p]) <= 2


def test_expected_events_of_many_groups(spark):
    rows = [(g, 1 + (g * 7 + i * 3) % 9, int((g + i) % 3 > 0)) for g in range(6) for i in range(8)] + [(None, 4, 1), (7, None, 1), (8, 3, None)]
    df = spark.createDataFrame(rows, "g int, t int, e int")
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {}
    for g in {r[0] for r in known}:
        own = [r for r in known if r[0] == g]
        expected = sum(sum(r[2] for r in known if r[1] == t) * sum(r[1] >= t for r in own) / sum(r[1] >= t for r in known) for t in {r[1] for r in known if r[2]})
        want[g] = (len(own), sum(r[2] for r in own), pytest.approx(expected))
    out = models.logrank_table(df, "t", "e", "g")
    assert {r.g: (r.n, r.observed, r.expected) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
