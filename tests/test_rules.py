"""House rules on hand-made tables: nulls, ties, order, empty groups, duplicate keys."""

import datetime as dt
import math
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepforge.functions import dates, numeric, strings
from stepforge.operators import clinical, combine, compare, models, order, programs, quality, reshape, step, summary
from stepforge.sources import readers


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(1, "a", 3.0), (2, "a", None), (3, None, 5.0), (4, "b", 7.0)], "id int, g string, x double")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_order_must_be_given(t):
    for fn in (lambda: order.row_n(t, None), lambda: order.lag(t, "x", "g", []), lambda: readers.preview(t, 2, None)):
        with pytest.raises(ValueError):
            fn()


def test_nulls_sort_last_unless_asked(t):
    assert [r.g for r in order.sort(t, ["g", "id"]).collect()] == ["a", "a", "b", None]
    assert [r.g for r in order.sort(t, [("g", True), "id"]).collect()] == ["b", "a", "a", None]
    assert order.sort(t, ["g"], sas_order=True).first().g is None


def test_null_levels(t):
    assert {r.g for r in summary.means(t, "x", ["n"], "g").collect()} == {"a", "b"}
    assert {r.g for r in summary.freq(t, "g", missing=True).collect()} == {"a", "b", None}
    assert sum(r.percent for r in summary.freq(t, "g").collect()) == pytest.approx(100)


def test_step_sees_earlier_assignments(t):
    out = step.Step(t).assign(x=F.col("id") * 10, y=F.col("x") + 1).rename({"y": "z"}).keep("id", "z", "none").frame()
    assert rows(out) == [(1, 11), (2, 21), (3, 31), (4, 41)]
    assert rows(t.select(step.if_chain([(F.col("x") > 6, "hi")], keep_existing="g").alias("v"))) == [("a",), ("a",), (None,), ("hi",)]


def test_arrays(t):
    assert step.array_cols("x08-x11 y") == ["x08", "x09", "x10", "x11", "y"]
    out = step.for_array(t.selectExpr("1 x1", "2 x2", "3 x3").limit(1), ["x1", "x2", "x3"], lambda c, i: c * i, 1, 3, 2)
    assert rows(out) == [(1, 2, 9)]


def test_merge_rules(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (None, "n", 0)], "k int, s string, v int")
    b = spark.createDataFrame([(2, 20), (3, 30), (None, 9)], "k int, v int")
    assert sorted(rows(combine.merge(a, b, "k", keep_if="a and b"))) == [(2, "y", 20)]
    assert sorted(rows(combine.merge(a, b, "k", keep_if="a")), key=str) == [(1, "x", 1), (2, "y", 20), (None, "n", 0)]
    assert sorted(rows(combine.merge(a, b, "k", keep_if="not a")), key=str) == [(3, 30), (None, 9)]
    doubled = combine.lookup(a, b.union(b).withColumnRenamed("v", "w"), "k", ["w"])  # fails when it runs, not before
    with pytest.raises(PySparkException, match="more than one row for a key"):
        doubled.collect()
    assert sorted(rows(combine.update(a, spark.createDataFrame([(1, None), (5, 5)], "k int, v int"), "k")), key=str) == [(1, "x", 1), (2, "y", 2), (5, None, 5), (None, "n", 0)]


def test_transpose_and_back(spark):
    long = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "a", 3)], "k string, id string, v int")
    wide = reshape.transpose(long, "k", "id", "v", "c_")
    assert sorted(rows(wide)) == [("u", 1, 2), ("v", 3, None)]
    back = reshape.to_long(wide, "k", ["c_a", "c_b"]).where("value is not null")
    assert sorted(rows(back)) == [("u", "c_a", 1), ("u", "c_b", 2), ("v", "c_a", 3)]
    with pytest.raises(ValueError):
        reshape.transpose(long.union(long), "k", "id", "v")


def test_row_n_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    assert sorted(rows(order.row_n(df, "k"))) == [(i, i + 1) for i in range(500)]
    assert rows(order.row_n(df.limit(0), "k")) == []


def test_ordered_fills(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 2.0), (1, 3, None), (1, 4, 6.0), (2, 1, None)], "g int, at int, x double")
    assert sorted(rows(order.interpolate(df, "x", "at", "g", "y"), "g", "at", "y")) == [(1, 1, None), (1, 2, 2.0), (1, 3, 4.0), (1, 4, 6.0), (2, 1, None)]
    assert [r.total for r in order.retain_sum(df, "x", "g", "at", init=10).orderBy("g", "at").collect()] == [10, 12, 12, 18, 10]


def test_strings(spark):
    df = spark.createDataFrame([("  o'neil-smith/jr (md) ", None)], "s string, e string")
    assert rows(df.select(strings.propcase(F.trim("s")), strings.catx("-", "s", "e", F.lit(" "), F.lit("z")), strings.scan("s", -1, " ("), strings.scan("s", 9), strings.index("s", "?"), strings.length("e"), strings.anydigit("s"))) == [
        ("O'neil-Smith/Jr (Md)", "o'neil-smith/jr (md)-z", "md)", None, 0, 1, 0)
    ]
    d = spark.createDataFrame([("01JAN2024", "2024-02-30")], "a string, b string").select(
        strings.input_("a", "date9."), strings.input_("b", "yymmdd10."), strings.put(strings.input_("a", "date9."), "date9.")
    )
    assert rows(d) == [(dt.date(2024, 1, 1), None, "01JAN2024")]


def test_numbers(spark):
    df = spark.createDataFrame([(2.5, None, -7)], "a double, b double, c int")
    got = rows(
        df.select(
            numeric.round_("a"), numeric.sum_of("a", "b"), numeric.sum_of("b"), numeric.mean_of("a", "b"), numeric.mod("c", 3), numeric.mod_floor("c", 3),
            numeric.int_(F.lit(-2.7)), numeric.divide("a", F.lit(0)), numeric.var_of("a", "b"), numeric.median_of("a", "c")
        )
    )
    assert got == [(3.0, 2.5, None, 2.5, -1, 2, -2, None, None, -2.25)]


def test_dates(spark):
    df = spark.sql("select date'2024-01-31' a, date'2024-02-01' b")
    assert rows(df.select(dates.intck("month", "a", "b"), dates.intck("month", "a", "b", "continuous"), dates.intnx("month", "a", 1), dates.intnx("month", "a", 1, "beginning"), dates.to_sas_date("a"), clinical.study_day(F.col("a"), F.col("b")), clinical.study_day(F.col("b"), F.col("b")))) == [
        (1, 0, dt.date(2024, 2, 29), dt.date(2024, 2, 1), 23406, -1, 1)
    ]


def test_quality(t):
    assert rows(quality.missing_profile(t), "variable", "missing") == [("g", 1), ("x", 1)]
    assert rows(quality.duplicates(t.union(t), "g")) == [(8, 5, 62.5)]
    assert rows(quality.duplicates(t.limit(0))) == [(0, 0, 0.0)]
    assert [r.x for r in quality.impute(t, {"x": "mean"}).orderBy("id").collect()] == [3.0, 5.0, 5.0, 7.0]


def test_compare_tolerance(spark):
    a = spark.createDataFrame([(1, 1000.0, "x"), (2, None, "y"), (3, 5.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1000.05, "x"), (2, None, "Y"), (4, 5.0, "z")], "k int, v double, s string")
    assert sorted(rows(compare.compare(a, b, "k"))) == [("s", 1, 1, 1, 1), ("v", 2, 0, 1, 1)]


def test_programs(spark):
    s = spark.createDataFrame([(1, "data a; set raw.x; run; data b; set a; run; data b; set b; run; RUN \n// c"), (2, "")], "id int, text string")
    e = programs.edges(s)
    assert sorted(rows(programs.external_inputs(e))) == [(1, "raw.x")]
    assert dict(rows(programs.dependency_depth(programs.step_edges(s)), "dataset", "depth")) == {"raw.x": 0, "a": 1, "b": 2}
    assert rows(programs.self_cycles(programs.step_edges(s))) == [(1, "b")]
    assert {r.issue for r in programs.lint(s).collect()} == {"comment", "trailing_blanks"}


def test_models(spark):
    df = spark.createDataFrame([(float(i), 2.0 + 3 * i + (-1) ** i, "ab"[i % 2], i % 4) for i in range(20)], "x double, y double, g string, s int")
    fit = models.reg(df, "y", "x")
    assert fit.coef[1] == pytest.approx(3, abs=0.02)
    assert models.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and models.f_tail(4.0, 1, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert models.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert models.tukey_tail(3.877676, 3, 10) == pytest.approx(0.05, abs=2e-3)
    with pytest.raises(ValueError):
        models.reg(df.withColumn("z", F.col("x") * 2), "y", ["x", "z"])
    surv = spark.createDataFrame([(1, 1, 0.0), (2, 1, 1.0), (3, 0, 0.0), (4, 1, 1.0), (5, 1, 0.0), (5, 1, 1.0)], "t int, e int, x double")
    assert [round(r.survival, 6) for r in models.km(surv, "t", "e").orderBy("t").collect()] == [round(v, 6) for v in (5 / 6, 2 / 3, 2 / 3, 4 / 9, 0.0)]

    def loglik(b):  # the partial likelihood of one covariate, by definition
        data, out = [(1, 1, 0.0), (2, 1, 1.0), (3, 0, 0.0), (4, 1, 1.0), (5, 1, 0.0), (5, 1, 1.0)], 0.0
        for time in sorted({r[0] for r in data if r[1]}):
            risk = sum(math.exp(b * r[2]) for r in data if r[0] >= time)
            tied = [r for r in data if r[0] == time and r[1]]
            own = sum(math.exp(b * r[2]) for r in tied)
            out += sum(b * r[2] for r in tied) - sum(math.log(risk - i / len(tied) * own) for i in range(len(tied)))
        return out

    best = max((i / 1000 for i in range(-3000, 3000)), key=loglik)
    assert models.cox(surv, "t", "e", "x").coef[0] == pytest.approx(best, abs=2e-3)
    groups = spark.createDataFrame([(g, float(10 * g + e)) for g in range(6) for e in (-1, 0, 1)], "g int, y double")
    m = models.mixed(groups.withColumn("x", F.rand(1)), "y", "x", "g")
    assert m.tau2 > 100 and m.sigma2 < 3


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "Id int, S string")
    readers.write_csv(df, f"{tmp_path}/c")
    assert rows(readers.read_csv(spark, f"{tmp_path}/c")) == [(1, "é")]
    assert readers.read_delim(spark, f"{tmp_path}/c", ",").columns == ["id", "s"]
    got = readers.split_fields(spark.createDataFrame([("1 . x",), ("q 2",)], "value string"), [("a", "double"), ("b", "double"), ("c", "string")])
    assert rows(got, "a", "b", "c") == [(1.0, None, "x"), (None, 2.0, None)]
    assert rows(readers.inline(spark, [(1,), (2, "b")], "a int, b string")) == [(1, None), (2, "b")]
    (tmp_path / "f.txt").write_bytes(b"\xff")
    r = readers.file_integrity(spark, f"{tmp_path}/f.txt").first()
    assert (r.size, r.format, r.encoding, r.is_empty) == (1, "txt", "latin-1", False)


def test_streamed_step(spark, tmp_path):
    from stepforge.streaming import rows as streaming

    df = spark.range(20).withColumn("x", F.col("id") * 2)
    df.write.parquet(f"{tmp_path}/in")
    s = streaming.stream_tables(spark, f"{tmp_path}/in", df)
    streaming.run_step(s, lambda d: step.Step(d).assign(y=F.col("x") + 1).subset("y > 10").frame(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15


def _ibm(x):
    """A double as an 8-byte IBM float."""
    if x is None:
        return b"." + b"\0" * 7
    if not x:
        return b"\0" * 8
    sign, x, e = (128 if x < 0 else 0), abs(x), 0
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | 64 + e]) + int(x * 2**56).to_bytes(7, "big")


def _xpt(rows):
    """A transport file with variables ID (numeric) and NAME (character, 8)."""
    import struct

    pad = lambda b, n=80, c=b" ": b + c * (-len(b) % n)
    head = lambda kind, tail: pad(f"HEADER RECORD*******{kind:<8}HEADER RECORD!!!!!!!{tail}".encode())
    when, zero = b"01JAN24:00:00:00", "0" * 30
    out = head("LIBRARY", zero) + pad(b"SAS     SAS     SASLIB  9.1     bsd4.2  " + b" " * 24 + when) + pad(when)
    out += head("MEMBER", "000000000000000001600000000140") + head("DSCRPTR", zero) + pad(b"SAS     T       SASDATA 9.1     bsd4.2  " + b" " * 24 + when) + pad(when)
    names = b"".join(
        struct.pack(
            ">hhhh8s40s8shhh2s8shhl52s", kind, 0, 8, i + 1, name, b" " * 40, b" " * 8, 0, 0, 0, b"\0\0", b" " * 8, 0, 0, 8 * i, b"\0" * 52
        ) for i, (kind, name) in enumerate([(1, b"ID      "), (2, b"NAME    ")])
    )
    data = b"".join(_ibm(i) + s.ljust(8).encode() for i, s in rows)
    return out + head("NAMESTR", "000000000200000000000000000000") + pad(names) + head("OBS", zero) + pad(data)


def test_transport_files(spark, tmp_path):
    (tmp_path / "a.xpt").write_bytes(_xpt([(1.0, "one"), (None, "none")]))
    (tmp_path / "b.xpt").write_bytes(_xpt([(-2.5, "two")]))
    got = readers.read_xpt(spark, f"{tmp_path}/*.xpt", "id double, name string").collect()
    assert sorted((r.name, None if r.id is None or math.isnan(r.id) else r.id) for r in got) == [("none", None), ("one", 1.0), ("two", -2.5)]


def test_fills_from_the_end_in_one_long_group(spark):
    df = spark.range(100_000).select("id", F.lit("a").alias("g"), F.when(F.col("id") % 50_000 == 49_999, F.col("id")).alias("x"))
    began = time.monotonic()
    assert order.carry_backward(df, "x", "g", "id", "next").where("next = id + (49999 - id % 50000)").count() == 100_000
    filled = order.interpolate(df.withColumn("x", F.col("x").cast("double")), "x", "id", "g", "v")
    assert filled.where("v = id").count() == 50_001 and time.monotonic() - began < 60


def test_depth_of_a_long_chain_and_of_a_cycle(spark):
    chain = [(1, f"d{i}", f"d{i + 1}") for i in range(24)]
    cycle = [(2, "a", "b"), (2, "b", "c"), (2, "c", "b"), (2, "c", "d"), (2, "a", "a")]
    got = {(r.id, r.dataset): r.depth for r in programs.dependency_depth(spark.createDataFrame(chain + cycle, "id long, src string, dst string")).collect()}
    assert got == {**{(1, f"d{i}"): i for i in range(25)}, (2, "a"): 0, (2, "b"): None, (2, "c"): None, (2, "d"): None}
