"""Running values by ranges against plain windows and against loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stepforge.operators import order, scan, summary
from stepforge.operators.scan import Running

def ahead():
    return {
        "total": Running("sum", "x"), "low": Running("min", "x"), "high": Running("max", "x"), "last": Running("last", "x"), "lag1": Running("lag", "x"),
        "lag4": Running("lag", "x", 4), "seq": Running("sum", F.lit(1))
    }


BEHIND = {"next": Running("last", "x"), "lead2": Running("lag", "x", 2), "rest": Running("sum", "x")}


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def loop(rows):
    """(id, values…) of rows (id, g, x), in order of id in each group."""
    out = []
    for g in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == g)
        xs = [r[2] for r in own]
        known = lambda part: [x for x in part if x is not None]
        for i, r in enumerate(own):
            up, down = known(xs[: i + 1]), known(xs[i:])
            ahead = [sum(up) if up else None, min(up, default=None), max(up, default=None), up[-1] if up else None, xs[i - 1] if i else None, xs[i - 4] if i > 3 else None, i + 1]
            out.append((r[0], *ahead, down[0] if down else None, xs[i + 2] if i + 2 < len(xs) else None, sum(down) if down else None))
    return sorted(out)


@pytest.mark.parametrize("by", [["g"], []])
def test_both_ways_equal_a_loop(spark, many_ranges, by):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a"] * 8 + ["b", "c", None]), rnd.choice([None, rnd.randrange(-50, 50)])) for i in range(400)] + [(900, "lone", None), (901, "two", 1), (902, "two", None)]
    df = spark.createDataFrame(rows, "id long, g string, x long").repartition(3)
    want = loop([(i, g if by else 0, x) for i, g, x in rows])
    for by_ranges in (True, False):
        out = scan.scan(df, by, "id", ahead(), BEHIND, by_ranges)
        assert out.columns == ["id", "g", "x", *ahead(), *BEHIND]
        assert sorted(tuple(r) for r in out.select("id", *ahead(), *BEHIND).collect()) == want


def test_a_lag_longer_than_a_range(spark, many_ranges):
    df = spark.createDataFrame([(i, i * 10) for i in range(20)], "id long, x long")
    got = scan.scan(df, [], ["id"], {"lag": Running("lag", "x", 11)}, by_ranges=True)
    assert sorted((r.id, r.lag) for r in got.collect()) == [(i, (i - 11) * 10 if i > 10 else None) for i in range(20)]


def test_descending_order_ties_and_clashes(spark, many_ranges):
    df = spark.createDataFrame([(i % 5, i) for i in range(60)], "k long, x long").withColumn("total", F.lit("old"))
    got = scan.scan(df, [], [("k", True)], {"total": Running("sum", F.lit(1))}, {"rest": Running("sum", F.lit(1))}, by_ranges=True).collect()
    assert sorted(r.total for r in got) == list(range(1, 61)) and all(r.total + r.rest == 61 for r in got)
    assert all((r.total - 1) // 12 == 4 - r.k for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, id long, x long")
    for by_ranges in (None, True, False):
        assert scan.scan(df, "g", "id", ahead(), BEHIND, by_ranges).collect() == []


def test_a_hot_group_takes_the_ranges(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(scan, "GROUP_ROWS", 1000)
    monkeypatch.setattr(scan.has_hot_group, "__defaults__", (1000,))
    df = spark.range(30_000).select("id", F.lit("hot").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("x"))
    assert scan.ranges(df, ["g"], [F.col("id").asc()]).select("__part").distinct().count() == 7
    plan = order.retain_sum(df, "x", "g", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan
    assert "__part" not in order.retain_sum(df.where("id < 900"), "x", "g", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert order.retain_sum(df, "x", "g", "id").agg(F.max("total")).first()[0] == sum(range(0, 30_000, 10))
    filled = order.interpolate(df, "x", "id", "g", "y")
    assert filled.where("id <= 29990 and abs(y - id) > 1e-9").count() == 0 and filled.where("y is null").count() == 9
    flags = order.first_last(df, "g", "id").where("is_first + is_last > 0")
    assert sorted((r.id, r.is_first, r.is_last) for r in flags.collect()) == [(0, 1, 0), (29999, 0, 1)]
    assert order.dif(df, "id", "g", "id", 3).where("dif = 3").count() == 29_997


@pytest.mark.parametrize("make", [lambda i: f"level {i:05}", lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i), float])
def test_cumulative_frequencies_of_many_levels(spark, many_ranges, monkeypatch, make):
    monkeypatch.setattr(scan.has_hot_group, "__defaults__", (50,))
    kind = {"str": "string", "date": "date", "float": "double"}[type(make(0)).__name__]
    df = spark.createDataFrame([(make(i % 300),) for i in range(700)] + [(None,)], f"v {kind}")
    out = summary.freq(df, "v")
    got = sorted((r.v, r["count"], r.cum_count) for r in out.collect())
    counts = [3 if i < 100 else 2 for i in range(300)]
    assert got == [(make(i), counts[i], sum(counts[: i + 1])) for i in range(300)]
    assert "__part" in out._jdf.queryExecution().optimizedPlan().toString()
    assert max(r.cum_percent for r in out.collect()) == pytest.approx(100)
    with_null = summary.freq(df, "v", missing=True).where("v is null").first()
    assert (with_null["count"], with_null.cum_count) == (1, 701)
