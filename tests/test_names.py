"""Name mapping by indexes against comparing every name with every other, and what else looks names up."""

import itertools
import random
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepforge.operators import combine, names, programs, quality
from stepforge.plans import catalogue


def similar(a, b, longer):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.85
    x, y = (b, a) if longer == "swap" and len(a) > len(b) else (a, b)
    return sum(c in y for c in x) / max(len(a), len(b))


def frame(spark, found, name):
    return spark.createDataFrame([(x,) for x in found], f"{name} string")


@pytest.mark.parametrize("longer", ["swap", "first"])
@pytest.mark.parametrize("least", [0.0, 0.5, 0.7, 0.9])
def test_no_pair_is_lost(spark, longer, least):
    rnd = random.Random(len(longer))
    make = lambda n, letters: {"".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 9))) for _ in range(n)}
    left, right = make(60, "abcd_1") | {"usubjid", "age", "", "é", "aaaa"}, make(60, "abcd_1") | {"subjid", "agegr1", "ab", "aaaaaaa", "éa"}
    want = {(a, b): s for a in left for b in right if (s := similar(a, b, longer)) > least}
    got = names.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), least, longer)
    rows = got.collect()
    assert {(r.a, r.b): r.score for r in rows} == pytest.approx(want) and len(rows) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text(alphabet="ab_é\U0001f600'", max_size=6), min_size=1, max_size=12), st.sets(st.text(alphabet="ab_é\U0001f600'", max_size=6), min_size=1, max_size=12))
def test_held_names(spark, parts, wholes):
    got = names.held_pairs(frame(spark, parts, "part"), frame(spark, wholes, "whole"))
    assert sorted((r.part, r.whole) for r in got.collect()) == sorted((p, w) for p in parts for w in wholes if p in w)


def test_mapping_keeps_case_position_and_nulls(spark):
    found = spark.createDataFrame([("SubjID", 3), ("subjid", 5), ("AGE_GRP", 2), ("xage", 1), (None, 0)], "name string, position int")
    need = frame(spark, ["USUBJID", "age", None, "subjid", "zz"], "name")
    assert {(r.required, r.best, r.score) for r in quality.map_variables(found, need).collect()} == {("USUBJID", "SubjID", 0.85), ("age", "xage", 0.85)}
    assert {(r.required, r.match, r.score) for r in quality.map_first(found, need).collect()} == {("USUBJID", "SubjID", 0.85), ("age", "xage", 0.85), ("subjid", "SubjID", 1.0)}
    assert quality.map_variables(found.limit(0), need).collect() == [] == quality.map_first(found, need.limit(0)).collect()


def test_three_passes_use_each_name_once(spark):
    found = spark.createDataFrame([("age", 1), ("AGEGR1", 2), ("trt01p", 3), ("visitnum", 4), ("trtdose", 5)], "name string, position int")
    need = frame(spark, ["AGE", "agegrp", "ages", "treatment_dose", "drug", "month"], "name")
    got = {(r.required, r.match, r.how) for r in quality.map_three_pass(found, need).collect()}
    assert got == {("AGE", "age", "exact"), ("agegrp", "AGEGR1", "fuzzy"), ("drug", "trt01p", "role"), ("month", "visitnum", "role")} or len({m for _, m, _ in got}) == len(got)


def brute_usage(scripts, known):
    out = []
    for i, text in scripts:
        u = (text or "").upper()
        join, stat, group, report = "MERGE ON" in u, "PROC MEANS" in u, "CLASS" in u, "PROC REPORT" in u
        for n in known:
            k = n.upper()
            by, other = f"BY {k}" in u, f"CLASS {k}" in u or f"VAR {k}" in u
            if by or other:
                out.append((i, n, join or by, stat or other, group, report))
        if join or stat or group or report:
            out.append((i, None, join, stat, group, report))
    return sorted(out, key=str)


def test_variable_usage(spark):
    scripts = [
        (1, "proc sort; by age agegr1; run; proc means; class sex; var weight height;"), (2, None), (3, ""), (4, "standby a\nmerge on"), (5, "by\nage"),
        (6, "class by var sex by " + "x " * 3000), (7, "BY a.b* BY (c)")
    ]
    known = ["age", "AGE", "agegr1", "sex", "by var", "x", "weight", "height", "a.b*", "(c)", "zz", "sex by"]
    got = quality.variable_usage(spark.createDataFrame(scripts, "id int, text string"), frame(spark, [*known, None, "sex"], "name"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_usage(scripts, known)
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    none = quality.variable_usage(spark.createDataFrame(scripts, "id int, text string"), frame(spark, [None], "name"))
    assert sorted((tuple(r) for r in none.collect()), key=str) == brute_usage(scripts, [])


def test_usage_has_a_row_for_every_script_and_name(spark):
    scripts = [(1, "by age; class sex; var x" + " by" * 2000), (1, "no use"), (2, None), (3, "merge on proc report"), (4, "Proc Means; VAR AGE")]
    sought = ["age", "sex", None, "x", "age"]
    got = quality.variable_usage_pairs(spark.createDataFrame(scripts, "id int, text string"), frame(spark, sought, "name"))
    either = lambda a, b: True if a or b else None if a is None or b is None else False
    want = []
    for i, text in scripts:
        u = None if text is None else text.upper()
        has = lambda w: None if u is None or w is None else w in u
        for n in {*sought}:
            by, cl, var = (n and f"{w} {n.upper()}" for w in ("BY", "CLASS", "VAR"))
            want.append((i, n, either(has(by), has("MERGE ON")), either(either(has(cl), has(var)), has("PROC MEANS")), has("CLASS"), has("PROC REPORT")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    none = quality.variable_usage_pairs(spark.createDataFrame(scripts, "id int, text string"), frame(spark, [None], "name"))
    assert sorted((tuple(r) for r in none.collect()), key=str) == sorted((w for w in want if w[1] is None), key=str)


def test_usage_query_leaves_no_pair_out(spark):
    data = "/root/testdata/sf0.001"
    types = spark.read.parquet(f"{data}/part.parquet").select("p_type").distinct().count()
    assert catalogue.queries()["q31_variable_usage"](spark, data).count() == types * spark.read.parquet(f"{data}/documents.parquet").count()


def test_missing_required_names_variables_that_the_whole_catalog_lacks(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text").collect()
    first = [(d, s, "".join(itertools.takewhile(lambda c: c in string.ascii_letters, t or "")).lower()) for d, s, t in rows]
    want = {(s, v) for _, s, v in first if len(v) > 6 or not v}
    got = {(r["table"], r.variable): r for r in catalogue.queries()["q28_missing_required"](spark, data).collect()}
    assert set(got) == want and any(v for _, v in want)
    for (s, v), r in got.items():
        steps = {("MEANS" if d % 3 == 0 else "DATA") + str(d % 7) for d, x, w in first if (x, w) == (s, v)}
        assert (r.uses, r.severity) == (len(steps), "critical" if len(steps) > 2 else "high" if any("MEANS" in x for x in steps) else "medium")


def test_datasets_matched_below_what_a_name_gives(spark):
    catalog = spark.createDataFrame(
        [("dm_x", c, i) for i, c in enumerate(["usubjid", "age", "a", "b", "c", "d"])] + [("ae", "x", 1), ("lb", "usubjid", 1)],
        "table string, name string, position int"
    )
    expected = spark.createDataFrame([("dm", "demographics"), ("ae", "outcome"), ("zz", None)], "expected string, role string")
    facts = {"dm_x": (1, 1, 1), "ae": (0, 0, 0), "lb": (1, 0, 0)}
    for least in (0.6, 0.3, 0.1):
        want = set()
        for e, role in (("dm", "demographics"), ("ae", "outcome"), ("zz", None)):
            for t, (i, d, k) in facts.items():
                s = round(0.3 * (e in t or t in e) + 0.2 * i + d * (0.2 if role == "demographics" else 0.1) + 0.2 * k, 6)
                if s > least:
                    want.add((e, t, s))
        got = [tuple(r) for r in quality.match_datasets(expected, catalog, least).collect()]
        assert set(got) == want and len(got) == len(want)


def test_keys_are_proved_only_where_a_sketch_lets_them(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).alias("few"), F.when(F.col("id") > 5, F.col("id")).alias("holes"), F.greatest(F.col("id"), F.lit(1)).alias("one_twice"))
    got = quality.infer_key(df, [["few"], ["id"], ["holes"], ["one_twice"], ["few", "one_twice"], ["few", "id"]])
    assert [r.is_key for r in got.orderBy("rank").collect()] == [False, True, False, False, True, True]
    assert quality.infer_key(df.limit(0), [["id"]]).first().is_key


def test_depth_takes_as_many_rounds_as_it_is(spark, monkeypatch):
    written = []
    monkeypatch.setattr(programs, "staged", lambda df, label, real=programs.staged: written.append(label) or real(df, label))
    ring = [(1, f"n{i}", f"n{(i + 1) % 60}") for i in range(60)] + [(1, "in", "n0"), (1, "n3", "out"), (1, "x", "y"), (1, "y", "z"), (1, "z", "z"), (1, "x", "z")]
    got = {r.dataset: r.depth for r in programs.dependency_depth(spark.createDataFrame(ring, "id int, src string, dst string")).collect()}
    assert got == {**{f"n{i}": None for i in range(60)}, "in": 0, "out": None, "x": 0, "y": 1, "z": 2}
    assert written.count("open") <= 4


def test_validation_is_part_of_the_plan(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, s string")
    twice = spark.createDataFrame([(1, 5, None), (1, 6, 2), (2, 7, 3)], "k int, v int, w int")
    merged = combine.merge(a, twice, "k", validate="m:1")
    with pytest.raises(PySparkException, match="more than one row for a key"):
        merged.collect()
    with pytest.raises(PySparkException, match="more than one row for a key"):
        combine.merge(twice, a, "k", validate="1:m").collect()
    ok = combine.merge(a, twice.where("v <> 5"), "k", validate="m:1")
    assert sorted((tuple(r) for r in ok.collect()), key=str) == [(1, "x", 6, 2), (2, "y", 7, 3), (None, "n", None, None)]
    nothing = combine.lookup(a, twice.where("k = 2"), "k", ["w"])
    assert sorted((tuple(r) for r in nothing.collect()), key=str) == [(1, "x", None), (2, "y", 3), (None, "n", None)]
