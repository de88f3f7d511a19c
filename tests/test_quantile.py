import random

import numpy as np

from stepforge.operators import quality as Q
from stepforge.operators import summary as A

SHAPE = "g string, x double, y int, s string"


def rows(n):
    rng = random.Random(4)
    return [(rng.choice(["hot", "hot", "b", None]), None if rng.random() < 0.1 else rng.choice([rng.gauss(0, 9), float(rng.randrange(4))]), rng.randrange(50), rng.choice("uvw")) for _ in range(n)]


def test_quantiles_and_modes_of_groups_against_numpy(spark):
    data = rows(4000)
    df = spark.createDataFrame(data, SHAPE).repartition(7)
    got = {r.g: r for r in A.means(df, ["x", "y"], ["n", "q1", "median", "q3", "mode"], "g", missing=True).collect()}
    assert set(got) == {"hot", "b", None}
    for g, r in got.items():
        for i, v in ((1, "x"), (2, "y")):
            values = [d[i] for d in data if d[0] == g and d[i] is not None]
            want = np.percentile(values, [25, 50, 75])
            assert r[f"n_{v}"] == len(values) and np.allclose([r[f"q1_{v}"], r[f"median_{v}"], r[f"q3_{v}"]], want)
            assert r[f"mode_{v}"] == min(sorted(set(values)), key=lambda e: (-values.count(e), e))
    assert {r.g for r in A.means(df, "x", ["median"], "g").collect()} == {"hot", "b"}


def test_quantiles_of_hard_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [("a", None, 1, "u"), ("i", inf, 1, "u"), ("i", inf, 1, "u"), ("n", 1.0, 1, "u"), ("n", 2.0, 1, "u"), ("n", nan, 1, "u"), ("z", -0.0, 1, "u"), ("z", 0.0, 1, "u")],
        SHAPE
    )
    got = {r.g: r.median_x for r in A.means(df, "x", ["median"], "g").collect()}
    assert got == {"a": None, "i": inf, "n": 2.0, "z": 0.0}
    none = df.limit(0)
    assert A.means(none, "x", ["median"], "g").collect() == []
    assert [tuple(r) for r in A.means(none, "x", ["median", "n"]).collect()] == [(None, 0)]


def test_imputed_text_and_numbers(spark):
    df = spark.createDataFrame([("a", 1.0, 1, "u"), ("a", None, 1, None), ("a", 3.0, 1, "u"), ("b", None, 1, "v"), (None, None, 1, None)], SHAPE)
    out = Q.impute(df, {"x": "median", "s": "mode"}, "g").collect()
    assert sorted((repr(r.g), r.x, r.s) for r in out) == [("'a'", 1.0, "u"), ("'a'", 2.0, "u"), ("'a'", 3.0, "u"), ("'b'", None, "v"), ("None", None, None)]


def test_no_group_is_held_by_one_task(spark):
    df = spark.createDataFrame(rows(50), SHAPE)
    plan = A.means(df, "x", ["median"], "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_running_sums_over_ranges_against_a_loop(spark):
    from stepforge.operators.order import dealt, running_sums

    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "b", None]), float(t), rng.randrange(5)) for t in range(500)]
    df = dealt(spark.createDataFrame(data, "g string, t double, n int"), ["g", "t"])
    up = {(r.g, r.t): r.total for r in running_sums(df, "g", "t", {"total": "n"}).collect()}
    down = {(r.g, r.t): r.total for r in running_sums(df, "g", "t", {"total": "n"}, descending=True).collect()}
    assert len(up) == len(down) == 500
    for g, t, _ in data:
        assert up[g, t] == sum(n for h, u, n in data if h == g and u <= t)
        assert down[g, t] == sum(n for h, u, n in data if h == g and u >= t)
