"""Descriptive statistics and frequency tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantile import add_order_stats
from .rules import as_list, numeric_cols
from .scan import Running, scan
from .storage import staged

STATS = {
    "n": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "var": lambda c: F.var_samp(c),
    "sum": lambda c: F.sum(c),
    "nmiss": lambda c: F.count_if(c.isNull()),
    "stderr": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "cv": lambda c: F.try_divide(100 * F.stddev_samp(c), F.avg(c)),
    "range": lambda c: F.max(c) - F.min(c),
}
#: Statistics that need the values in order.
ORDERED = {"median": 0.5, "q1": 0.25, "q3": 0.75, "mode": "mode"}
DEFAULT = ["n", "mean", "std", "min", "max"]


def means(df: DataFrame, vars=None, stats: list[str] | None = None, class_=None, missing: bool = False) -> DataFrame:
    """MEANS: one column ``{stat}_{var}`` for each pair, by CLASS levels; null levels only with ``missing``.

    Moments and extremes are one aggregate that combines before its shuffle; quantiles and modes are found by counted values.
    """
    class_, vars = as_list(class_), as_list(vars) or [c for c in numeric_cols(df) if c not in as_list(class_)]
    if class_ and not missing:
        df = df.na.drop(subset=class_)
    wanted = [(s, v) for v in vars for s in stats or DEFAULT]
    plain = [STATS[s](F.col(v)).alias(f"{s}_{v}") for s, v in wanted if s not in ORDERED]
    ordered = {f"{s}_{v}": (v, ORDERED[s]) for s, v in wanted if s in ORDERED}
    out = df.groupBy(*class_).agg(*plain or [F.count(F.lit(1)).alias("__rows")])
    return add_order_stats(out, df, class_, ordered).select(*class_, *[f"{s}_{v}" for s, v in wanted])


summary = means


def means_long(df: DataFrame, vars=None, stats: list[str] | None = None) -> DataFrame:
    """One row per variable; variables without a value are left out."""
    vars, stats = as_list(vars) or numeric_cols(df), stats or DEFAULT
    wide = means(df, vars, list(dict.fromkeys([*stats, "n"])))
    rows = [F.struct(F.lit(v).alias("variable"), *[F.col(f"{s}_{v}").cast("double").alias(s) for s in stats], F.col(f"n_{v}").alias("__n")) for v in vars]
    return wide.select(F.inline(F.array(*rows))).where("__n > 0").drop("__n")


def freq(df: DataFrame, tables, missing: bool = False, cumulative: bool = True) -> DataFrame:
    """FREQ: count and percent of each level or combination, by value; cumulatives follow that order.

    Running counts are taken over the written table of levels, of any type: by ranges of their order where it
    has more levels than a task should hold.
    """
    tables = as_list(tables)
    df = df if missing else df.na.drop(subset=tables)
    counts = df.groupBy(*tables).agg(F.count(F.lit(1)).alias("count"))
    running = cumulative and len(tables) == 1
    counts = staged(counts, "levels") if running else counts
    total = counts.agg(F.sum("count").alias("__t"))
    if running:
        counts = scan(counts, [], tables[0], {"cum_count": Running("sum", "count")})
    out = counts.crossJoin(F.broadcast(total)).withColumn("percent", 100 * F.col("count") / F.col("__t"))  # one row
    if running:
        out = out.withColumn("cum_percent", 100 * F.col("cum_count") / F.col("__t")).select(*tables, "count", "percent", "cum_count", "cum_percent")
    return out.drop("__t")


def freq_out(df: DataFrame, by, name: str = "count") -> DataFrame:
    """Counts to a dataset."""
    return df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, row: str, col: str, values: list | None = None) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def tabulate(df: DataFrame, by: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """variable, level, group, text: "median (q1, q3)" of numbers and "n (p%)" of levels."""
    parts = []
    num = lambda c: F.format_string("%.1f", F.round(c, 1))
    for v in numeric:
        median, q1, q3 = (num(F.col(f"{s}_{v}")) for s in ("median", "q1", "q3"))
        text = F.concat(median, F.lit(" ("), q1, F.lit(", "), q3, F.lit(")"))
        parts.append(
            means(df, v, ["median", "q1", "q3"], by, True).select(F.lit(v).alias("variable"), F.lit(None).cast("string").alias("level"), F.col(by).alias("group"), text.alias("text"))
        )
    for v in categorical:
        n = df.groupBy(F.col(by).alias("group"), F.col(v).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy("group"))
        parts.append(n.select(F.lit(v).alias("variable"), "level", "group", F.concat(F.col("n").cast("string"), F.lit(" ("), num(share), F.lit("%)")).alias("text")))
    return reduce(DataFrame.unionByName, parts)


def report(df: DataFrame, columns: list[str], where=None) -> DataFrame:
    return (df if where is None else df.where(where)).select(*columns)


def univariate(df: DataFrame, vars=None) -> DataFrame:
    """One row per variable: min, q1, median, mean, q3, max, nmiss, skewness, kurtosis (population; a normal has 3)."""
    vars = as_list(vars) or numeric_cols(df)
    shape = {"skewness": F.skewness, "kurtosis": lambda c: F.kurtosis(c) + 3}
    out = df.agg(*[STATS[s](F.col(v)).alias(f"{s}_{v}") for v in vars for s in ("min", "mean", "max", "nmiss")], *[fn(v).alias(f"{s}_{v}") for v in vars for s, fn in shape.items()])
    out = add_order_stats(out, df, [], {f"{s}_{v}": (v, ORDERED[s]) for v in vars for s in ("q1", "median", "q3")})
    names = ["min", "q1", "median", "mean", "q3", "max", "nmiss", "skewness", "kurtosis"]
    whole = lambda s, v: F.col(f"{s}_{v}") if s == "nmiss" else F.col(f"{s}_{v}").cast("double")
    return out.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), *[whole(s, v).alias(s) for s in names]) for v in vars])))


def normality(df: DataFrame, x: str) -> DataFrame:
    """Jarque-Bera statistic and its chi-square (2) tail, over all rows."""
    n, s, k = F.count(x), F.skewness(x), F.kurtosis(x)
    out = df.agg(n.alias("n"), (n / 6 * (s * s + k * k / 4)).alias("jb"))
    return out.withColumn("p_value", F.exp(-F.col("jb") / 2))


def corr_matrix(df: DataFrame, vars=None, digits: int = 4, block: int = 400) -> DataFrame:
    """var1, var2, r: Pearson over pairwise complete rows, rounded; ``block`` pairs in an aggregate."""
    vars = as_list(vars) or numeric_cols(df)
    pairs = [(a, b) for a in vars for b in vars]
    frames = []
    for at in range(0, len(pairs), block):
        cells = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.round(F.corr(a, b), digits).alias("r")).alias(f"__{i}") for i, (a, b) in enumerate(pairs[at : at + block])]
        frames.append(df.agg(*cells).select(F.inline(F.array(*[f"__{i}" for i in range(len(cells))]))))
    return reduce(DataFrame.unionByName, frames)


def corr_tests(df: DataFrame, vars=None) -> DataFrame:
    """var1, var2, n, r, t: pairwise N and the t statistic with n - 2 degrees of freedom."""
    vars = as_list(vars) or numeric_cols(df)
    cells = []
    for i, a in enumerate(vars):
        for b in vars[i + 1 :]:
            cells.append(
                F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.corr(a, b).alias("r")).alias(f"__{len(cells)}")
            )
    out = df.agg(*cells).select(F.inline(F.array(*[f"__{i}" for i in range(len(cells))])))
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def scalar(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """A one-row frame that other frames can cross with, as SELECT … INTO does."""
    return df.agg(value.alias(name))


def with_scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """A one-row frame's columns on every row."""
    return df.crossJoin(F.broadcast(one))


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest groups, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(key)).limit(k)


def kpis(df: DataFrame, counts: dict[str, Column], averages: dict[str, Column]) -> DataFrame:
    """Conditional counts and means in one row."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in counts.items()], *[F.avg(c).alias(k) for k, c in averages.items()])


def success_rate(df: DataFrame, ok: Column, by=None) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.round(100 * F.avg(ok.cast("int")), 2).alias("success_rate"))


def severity_counts(df: DataFrame, id: str, severity: str, levels: list[str]) -> DataFrame:
    return df.groupBy(id).agg(*[F.count_if(F.col(severity) == v).alias(v) for v in levels])


def issue_list(df: DataFrame, id: str, counts: list[str], k: int | None = None) -> DataFrame:
    """id, issue, n: one row per count that is not zero, the first k of each row in the order given."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).cast("long").alias("n")) for c in counts]), lambda x: x["n"] > 0)
    return df.select(id, F.inline(cells if k is None else F.slice(cells, 1, k)))
