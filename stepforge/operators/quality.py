"""Dataset qualification: profiles, imputation, name mapping, scores and decisions.

A *catalog* is a frame (table, name, position) with one row per column of each table; a
*requirement* is a frame (name) or (table, name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import held_pairs, similar_pairs, similarity
from .order import carry_backward, carry_forward, interpolate
from .quantile import add_order_stats
from .rules import as_list, need_order, type_class
from .storage import staged

# Name patterns of roles, dataset classes and importance, in the order in which they are tried.
ROLES = {
    "demographics": ["age", "sex", "race", "weight", "height", "dm"],
    "treatment": ["trt", "dose", "regimen", "drug", "therapy"],
    "outcome": ["efficacy", "safety", "aes", "response", "event"],
    "timing": ["day", "visit", "month", "date", "time", "week"],
}
SIGNATURES = {
    "SDTM": (["usubjid", "visit", "visitnum", "visitdat"], r"(dm|ae|cm|lb|vs|ex|mh|su)\b", 0.3),
    "ADaM": (["usubjid", "ady", "avisit", "avisitn"], r"(adsl|adae|adlb|advs|adex|admh)\b", 0.3),
    "TLF": (["table", "figure", "listing", "page"], r"t_|f_|l_", 0.2),
    "RAW": ([], r"raw_|source_|input_", 0.2),
}
CLINICAL = ["usubjid", "visit", "avisit", "ady", "dmy"]
DATASET_ROLES = [
    (["dm", "demographic"], "SDTM Demographics"), (["ae", "adverse"], "SDTM Adverse Events"), (["adsl"], "ADaM Subject Level"), (["qc", "compare"], "QC Reference"),
    (["lookup", "code"], "Lookup/Reference"), (["raw", "source"], "Raw Input"), (["adam"], "ADaM Analysis"),
]
CRITICAL = ["usubjid", "subjid", "id", "trt", "treatment"]
IMPORTANT = ["age", "baseline", "visit", "day"]


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def contents(df: DataFrame) -> DataFrame:
    """position, name, type, class and n (rows of the frame): one row per column."""
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(type_class(f.dataType)).alias("class")
        ) for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*cells)), "n")


def check_schema(catalog: DataFrame, required: DataFrame) -> DataFrame:
    """table, name, status: required names that are found or missing, and extra ones, in lower case."""
    have = catalog.select("table", F.lower("name").alias("name")).distinct().withColumn("h", F.lit(1))
    tables = have.select("table").distinct()
    want = (required if "table" in required.columns else tables.crossJoin(required)).select("table", F.lower("name").alias("name")).distinct().withColumn("w", F.lit(1))
    both = have.join(want, ["table", "name"], "full")
    return both.select("table", "name", F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "extra").otherwise("found").alias("status"))


#: Standard error of the sketches that rule out keys; a candidate is ruled out from ten of them on.
SKETCH_ERROR = 0.01


def infer_key(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """rank, columns, is_key: which candidate column lists are unique and without nulls.

    One pass counts nulls and sketches the distinct values of all candidates; those with a null, or ten standard
    errors short of the rows, are no keys. Each of the others is proved by counting its values, as 128 bits, alone.
    """
    null = lambda c: reduce(lambda a, b: a | b, [F.col(x).isNull() for x in c])
    seen = df.agg(F.count(F.lit(1)), *[v for c in candidates for v in (F.count_if(null(c)), F.approx_count_distinct(F.struct(*c), SKETCH_ERROR))]).first()
    rows = []
    for i, c in enumerate(candidates):
        nulls, distinct = seen[1 + 2 * i], seen[2 + 2 * i]
        is_key = not nulls and distinct >= (1 - 10 * SKETCH_ERROR) * seen[0]
        if is_key:
            counted = df.groupBy(F.xxhash64(*c).alias("h1"), F.xxhash64(F.lit("second"), *c).alias("h2")).agg(F.count(F.lit(1)).alias("n"))
            is_key = (counted.agg(F.max("n")).first()[0] or 0) <= 1
        rows.append((i + 1, ",".join(c), is_key))
    return df.sparkSession.createDataFrame(rows, "rank int, columns string, is_key boolean")


def duplicates(df: DataFrame, keys=None) -> DataFrame:
    """rows, duplicates (beyond the first of each kind; nulls are a value) and percent."""
    counts = df.groupBy(*(as_list(keys) or df.columns)).agg(F.count(F.lit(1)).alias("c"))
    out = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("duplicates"), "rows"), F.lit(0.0)))


def missing_profile(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """variable, missing, percent, criticality; columns without nulls only with ``all_columns``."""
    total = F.count(F.lit(1))
    cells = [F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("missing"), total.alias("n")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    out = df.agg(*cells).select(F.inline(F.array(*[f"c{i}" for i in range(len(cells))])))
    p = F.coalesce(F.try_divide(100.0 * F.col("missing"), "n"), F.lit(0.0))
    out = out.select("variable", "missing", p.alias("percent"), F.when(p > 50, "high").when(p > 20, "medium").otherwise("low").alias("criticality"))
    return out if all_columns else out.where("missing > 0")


def missing_overall(df: DataFrame) -> DataFrame:
    """percent of all cells."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(F.round(F.try_divide(100.0 * nulls, F.count(F.lit(1)) * len(df.columns)), 6).alias("percent"))


def missing_pattern(df: DataFrame, vars: list[str], order_by) -> DataFrame:
    """variable, percent, pattern (none, monotone, systematic, random) and tail_missing.

    Monotone: the whole column is missing. tail_missing: nulls are the rows after the last value in
    the given order, found by comparing two positions per column instead of a window.
    """
    need_order(order_by)
    at = F.struct(*[F.col(k) for k in as_list(order_by)])
    cells = []
    for i, v in enumerate(vars):
        c = F.col(v)
        cells.append(
            F.struct(
                F.lit(v).alias("variable"), F.count_if(c.isNull()).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.when(c.isNotNull(), at)).alias("last"),
                F.min(F.when(c.isNull(), at)).alias("gap")
            ).alias(f"c{i}")
        )
    flat = df.agg(*cells).select(F.inline(F.array(*[f"c{i}" for i in range(len(cells))])))
    p = 100.0 * F.col("m") / F.col("n")
    pattern = F.when(F.col("m") == 0, "none").when(F.col("m") == F.col("n"), "monotone").when(p > 50, "systematic").otherwise("random")
    return flat.select("variable", p.alias("percent"), pattern.alias("pattern"), F.coalesce((F.col("m") > 0) & (F.col("gap") > F.col("last")), F.col("m") > 0).alias("tail_missing"))


def imputation_advice(profile: DataFrame) -> DataFrame:
    """strategy for rows (variable, percent, pattern)."""
    v = F.lower("variable")
    advice = (
        F.when(F.col("percent") > 50, "keep").when(F.col("pattern") == "monotone", "locf").when(_any(v, ["date", "time"]), "linear_interpolation")
        .when(_any(v, ["age", "weight", "height", "lab"]), "median").otherwise("keep")
    )
    return profile.withColumn("strategy", advice)


def handling_advice(variables: DataFrame) -> DataFrame:
    """criticality and strategy for rows (variable, percent, datatype, usage)."""
    u, p = F.col("usage"), F.col("percent")
    grouped = _any(F.lower(u), ["class", "by"])
    text = F.lower("datatype").isin("char", "text", "varchar")
    criticality = F.when(grouped, "critical").when(p > 50, "high").when(p > 20, "medium").otherwise("low")
    strategy = (
        F.when(grouped, "reject").when(_any(u, ["PROC MEANS", "PROC UNIVARIATE"]), "leave_missing").when(F.contains(u, F.lit("PROC SQL")) & F.contains(u, F.lit("JOIN")), "reject")
        .when(p >= 30, "leave_missing").when(text, "mode").otherwise("mean")
    )
    return variables.withColumns({"criticality": criticality, "strategy": strategy})


def impute(df: DataFrame, how: dict[str, str], by=None) -> DataFrame:
    """Fill nulls by the mean, median or mode of the column, or of its BY group."""
    mean = [F.avg(c).alias(f"__{c}") for c, s in how.items() if s == "mean"]
    values = df.groupBy(*as_list(by)).agg(*mean or [F.count(F.lit(1)).alias("__rows")])
    values = add_order_stats(values, df, as_list(by), {f"__{c}": (c, {"median": 0.5, "mode": "mode"}[s]) for c, s in how.items() if s != "mean"})
    values = values.select(*as_list(by), *[f"__{c}" for c in how])
    out = df.join(values, as_list(by), "left") if by else df.crossJoin(F.broadcast(values))
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in how}).drop(*[f"__{c}" for c in how])


def impute_ordered(df: DataFrame, x: str, by, order_by: str, how: str) -> DataFrame:
    """Fill nulls by locf, nocb or interpolation."""
    if how == "interpolation":
        return interpolate(df, x, order_by, by, "__v").withColumn(x, F.col("__v")).drop("__v")
    fill = {"locf": carry_forward, "nocb": carry_backward}[how]
    return fill(df, x, by, order_by, "__v").withColumn(x, F.coalesce(x, "__v")).drop("__v")


def _named(found: DataFrame) -> DataFrame:
    """One row for each name of a catalog but for case: its lower case, the first by position, and that position."""
    return found.where("name is not null").groupBy(F.lower("name").alias("b")).agg(F.min_by("name", F.struct("position", "name")).alias("name"), F.min("position").alias("position"))


def map_variables(found: DataFrame, required: DataFrame, least: float = 0.7) -> DataFrame:
    """required, best, score: the most similar found name of each required name that is not found itself.

    Both are tables of names; ties go to the earlier ``position``.
    """
    want = required.join(found.select("name"), "name", "left_anti").where("name is not null").select(F.col("name").alias("required"), F.lower("name").alias("a"))
    have = staged(_named(found), "found")
    pairs = similar_pairs(want.select("a").distinct(), have, least).join(have, "b")
    best = pairs.groupBy("a").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("position"))).alias("m"))
    return want.join(best, "a").select("required", F.col("m.name").alias("best"), F.col("m.score").alias("score"))


def map_first(found: DataFrame, required: DataFrame, least: float = 0.7) -> DataFrame:
    """required, match, score: the first found name by position that is similar enough."""
    want = required.where("name is not null").select(F.col("name").alias("required"), F.lower("name").alias("a"))
    have = staged(_named(found), "found")
    pairs = similar_pairs(want.select("a").distinct(), have, least, "first").join(have, "b")
    first = pairs.groupBy("a").agg(F.min_by(F.struct("name", "score"), "position").alias("m"))
    return want.join(first, "a").select("required", F.col("m.name").alias("match"), F.col("m.score").alias("score"))


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of rows (required, name, position, score) the best of each required name by (score, position), of these the best of each name by (score, required)."""
    best = pairs.groupBy("required").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("position"), F.col("name"))).alias("m")).select("required", "m.name", "m.score")
    return best.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "required")).alias("m")).select("m.required", F.col("name").alias("match"), (-F.col("m.s")).alias("score"))


def map_three_pass(found: DataFrame, required: DataFrame) -> DataFrame:
    """required, match, score, how: exact names, then similarity over 0.75, then the same role (0.75); each found name once.

    Within a pass a name goes to its best required name by (score, position), and back; ties go to the earlier name.
    In the last pass all names of a role are alike, so the first found and the first required of a role are the pair.
    """
    left_f, left_r, parts = found.where("name is not null"), required.where("name is not null").select(F.col("name").alias("required")), []
    for how in ("exact", "fuzzy", "role"):
        f, r = left_f.withColumn("b", F.lower("name")), left_r.withColumn("a", F.lower("required"))
        if how == "exact":
            pairs = f.join(r, F.col("a") == F.col("b")).withColumn("score", F.lit(1.0))
        elif how == "fuzzy":
            near = similar_pairs(r.select("a").distinct(), f.select("b").distinct(), 0.75)
            pairs = near.join(r, "a").join(f.groupBy("b").agg(F.min(F.struct("position", "name")).alias("n")).select("b", "n.*"), "b")
        else:
            f = f.groupBy(role(F.col("name")).alias("role")).agg(F.min(F.struct("position", "name")).alias("n"))
            r = r.groupBy(role(F.col("required")).alias("role")).agg(F.min("required").alias("required"))
            pairs = f.join(r, "role").where("role <> 'unknown'").select("required", "n.*", F.lit(0.75).alias("score"))
        done = staged(_one_each(pairs).withColumn("how", F.lit(how)), how)
        parts.append(done)
        left_f = left_f.join(done.select(F.col("match").alias("name")), "name", "left_anti")
        left_r = left_r.join(done.select("required"), "required", "left_anti")
    return reduce(DataFrame.unionByName, parts)


def role(name: Column) -> Column:
    """Role of a variable by its name."""
    out = F.lit("unknown")
    for r, words in reversed(ROLES.items()):
        out = F.when(_any(F.lower(name), words), r).otherwise(out)
    return out


def classify(catalog: DataFrame) -> DataFrame:
    """table, class, score: SDTM, ADaM, TLF or RAW by table name and columns, else Unknown; ties go to the earlier class."""
    n = F.lower("name")
    hits = [F.count_distinct(F.when(n.isin(vars), n)).alias(k) for k, (vars, *_) in SIGNATURES.items() if vars]
    found = catalog.groupBy("table").agg(*hits, F.bool_or(_any(n, CLINICAL)).alias("clinical"))
    scores = []
    for i, (k, (vars, pattern, boost)) in enumerate(SIGNATURES.items()):
        score = F.rlike(F.lower("table"), F.lit(pattern)).cast("double") * boost + (F.col(k) / len(vars) * 0.4 if vars else 0)
        score = score + F.col("clinical").cast("double") * 0.1 if k in ("SDTM", "ADaM") else score
        scores.append(F.struct(F.round(score, 6).alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("class")))
    best = F.array_max(F.array(*scores))
    return found.select("table", F.when(best["score"] > 0, best["class"]).otherwise("Unknown").alias("class"), best["score"].alias("score"))


def classify_by_prefix(catalog: DataFrame) -> DataFrame:
    """table, class by column prefixes: SDTM, ADaM, TLF, else Raw."""
    n = F.lower("name")
    flags = catalog.groupBy("table").agg(
        F.bool_or(F.startswith(n, F.lit("ae"))).alias("s"), F.bool_or(_any(n, ["ady", "aval"])).alias("a"), F.bool_or(_any(n, ["table", "figure"])).alias("t")
    )
    return flags.select("table", F.when(F.col("s"), "SDTM").when(F.col("a"), "ADaM").when(F.col("t"), "TLF").otherwise("Raw").alias("class"))


def dataset_role(table: Column) -> Column:
    out = F.lit("Unknown")
    for words, name in reversed(DATASET_ROLES):
        out = F.when(_any(F.lower(table), words), name).otherwise(out)
    return out


def importance(name: Column) -> Column:
    """critical, important or optional."""
    return F.when(_any(F.lower(name), CRITICAL), "critical").when(_any(F.lower(name), IMPORTANT), "important").otherwise("optional")


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def score_a(facts: DataFrame) -> DataFrame:
    """Scores and decision for rows (required, missing, extra, duplicate_percent, clinical, high_missing, average_missing)."""
    c = F.col
    out = facts.withColumns({
        "structure": _clamp(100 - 5 * c("missing") - 2 * c("extra")),
        "variables": _clamp(100 - F.when(c("required") > 0, 100.0 * c("missing") / (c("required") + c("missing"))).otherwise(0)),
        "relationships": _clamp(100 - F.least(F.lit(50.0), c("duplicate_percent"))),
        "clinical_score": _clamp(F.when(c("clinical"), 80).otherwise(50) - 10 * c("high_missing")),
        "data_quality": _clamp(100 - 0.5 * c("average_missing")),
    })
    overall = (c("structure") + c("variables") + c("relationships") + c("clinical_score") + c("data_quality")) / 5
    return out.withColumn("overall", F.round(overall, 1)).withColumn("decision", decision(overall))


def decision(overall: Column) -> Column:
    return F.when(overall >= 90, "accepted").when(overall >= 70, "accepted_with_warning").when(overall >= 50, "needs_review").otherwise("rejected")


def score_b(facts: DataFrame) -> DataFrame:
    """overall, ready, status and issue counts for rows (columns, required, found, missing_percent, has_duplicates)."""
    c = F.col
    variables = F.when(c("required") > 0, 100.0 * c("found") / c("required")).otherwise(100.0)
    overall = (F.when(c("columns") > 0, 100).otherwise(0) + variables + 95 + 90 + 85 + F.greatest(F.lit(0.0), 100 - c("missing_percent"))) / 6
    issues = c("has_duplicates").cast("int") + (c("missing_percent") > 30).cast("int")
    advice = (c("missing_percent") > 20).cast("int") + c("has_duplicates").cast("int") + (c("columns") > 100).cast("int")
    status = F.when(overall < 80, "needs_review").when(issues > 0, "accepted_with_warning").otherwise("accepted")
    return facts.withColumns({"overall": F.round(overall, 1), "ready": overall >= 80, "issues": issues, "advice": advice, "status": status})


def score_c(facts: DataFrame) -> DataFrame:
    """overall and ready for rows (has_schema, required, missing, extra)."""
    c = F.col
    variables = F.when(c("required") > 0, 100.0 * (c("required") - c("missing")) / c("required")).otherwise(95.0)
    overall = F.when(c("has_schema"), (100 - 5 * c("extra") + variables + 90 + 85) / 4).otherwise(85.0)
    return facts.withColumns({"overall": F.round(overall, 1), "ready": overall >= 80})


def readable(df: DataFrame) -> DataFrame:
    """rows, readable, types_ok, structure_ok and status of a frame."""
    known = all(type_class(f.dataType) != "character" or f.dataType.simpleString() == "string" for f in df.schema.fields)
    some = reduce(lambda a, b: a | b, [F.count(c) > 0 for c in df.columns], F.lit(False))
    out = df.agg(F.count(F.lit(1)).alias("rows"), some.alias("structure_ok")).select("rows", (F.col("rows") > 0).alias("readable"), F.lit(known).alias("types_ok"), "structure_ok")
    return out.withColumn("status", F.when(F.col("readable") & F.col("types_ok") & F.col("structure_ok"), "accepted").when(F.lit(bool(df.columns)), "warning").otherwise("rejected"))


def schema_score(mapped: DataFrame, required: DataFrame) -> DataFrame:
    """Percent of required names matched above 0.8; 95 where none are required."""
    one = mapped.agg(F.count_if(F.col("score") > 0.8).alias("m")).crossJoin(required.agg(F.count(F.lit(1)).alias("n")))
    return one.select(F.coalesce(F.try_divide(100.0 * F.col("m"), "n"), F.lit(95.0)).alias("schema_score"))


def match_datasets(expected: DataFrame, catalog: DataFrame, least: float = 0.6) -> DataFrame:
    """expected, table, confidence for rows (expected, role) against the tables of a catalog.

    0.3 where one name holds the other, 0.2 for a subject id, 0.2 for demographic columns (0.1 where the expected
    role is another), 0.2 for over five columns. Names that hold one another are found by their pieces; without,
    a table reaches the limit by its own facts, and then for all expected of a role alike.
    """
    n = F.lower("name")
    facts = catalog.groupBy("table").agg(F.bool_or(n.isin("usubjid", "subjid")).alias("i"), F.bool_or(n.isin("age", "sex", "race", "weight")).alias("d"), F.count(F.lit(1)).alias("k"))
    own = F.when(F.col("i"), 0.2).otherwise(0.0) + F.when(F.col("d"), F.when(F.col("same"), 0.2).otherwise(0.1)).otherwise(0.0) + F.when(F.col("k") > 5, 0.2).otherwise(0.0)
    both = facts.withColumn("same", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("own", own)
    both = staged(both.select("table", F.lower("table").alias("t"), "same", "own"), "facts")
    want = staged(
        expected.where("expected is not null").select("expected", F.lower("expected").alias("e"), F.coalesce(F.col("role") == "demographics", F.lit(False)).alias("same")),
        "expected"
    )
    e, t = want.select("e").distinct(), both.where("t is not null").select("t").distinct()
    inner = held_pairs(e.withColumnRenamed("e", "part"), t.withColumnRenamed("t", "whole")).select(F.col("part").alias("e"), F.col("whole").alias("t"))
    outer = held_pairs(t.withColumnRenamed("t", "part"), e.withColumnRenamed("e", "whole")).select(F.col("whole").alias("e"), F.col("part").alias("t"))
    named = inner.union(outer).distinct()
    rated = lambda df, more: df.withColumn("confidence", F.round(F.least(F.col("own") + more, F.lit(1.0)), 6)).where(F.col("confidence") > least)
    out = rated(named.join(want, "e").join(both, ["t", "same"]), 0.3).select("e", "t", "expected", "table", "confidence")
    if least < 0.6:  # every row of this join is a result, but for those already named
        alone = rated(both, 0.0).join(want, "same").join(named, ["e", "t"], "left_anti")
        out = out.unionByName(alone.select("e", "t", "expected", "table", "confidence"))
    return out.select("expected", "table", "confidence")


def missing_required(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """table, variable, uses, severity: used variables (table, variable, step) that a table lacks."""
    have = catalog.select("table", F.lower("name").alias("v")).distinct()
    gone = usage.withColumn("v", F.lower("variable")).join(have, ["table", "v"], "left_anti")
    s = F.upper("step")
    out = gone.groupBy("table", "variable").agg(F.count_distinct("step").alias("uses"), F.bool_or(_any(s, ["REPORT", "MEANS"])).alias("shown"))
    return out.select("table", "variable", "uses", F.when(F.col("uses") > 2, "critical").when(F.col("shown"), "high").otherwise("medium").alias("severity"))


def quality_dimensions(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """dimension, percent: completeness, uniqueness, and the pass rate of each rule given."""
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    one = df.agg(
        (100.0 - 100.0 * cells / (F.count(F.lit(1)) * len(df.columns))).alias("completeness"), *[
            (100.0 * F.avg(F.coalesce(r, F.lit(False)).cast("int"))).alias(k) for k, r in (rules or {}).items()
        ]
    ).crossJoin(duplicates(df).select((100.0 - F.col("percent")).alias("uniqueness")))
    return one.unpivot([], one.columns, "dimension", "percent")


def compliance(catalog: DataFrame, standard: DataFrame) -> DataFrame:
    """table, expected, found, percent against a standard's names."""
    return check_schema(catalog, standard).groupBy("table").agg(
        F.count_if(F.col("status") != "extra").alias("expected"), F.count_if(F.col("status") == "found").alias("found")
    ).withColumn("percent", F.round(F.try_divide(100.0 * F.col("found"), "expected"), 4))


def _key_words(scripts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Scripts (id, marks of their own words, by, stat), names (name, key in upper case), and whether one is not null.

    Nothing is compared with every name: what follows BY, and CLASS or VAR, is cut at each length that names have.
    """
    known = staged(names.select("name", F.upper("name").alias("key")).distinct(), "names")
    lengths = [r[0] for r in known.where("key is not null").select(F.length("key").alias("n")).distinct().orderBy("n").collect()]  # no more than the longest name has letters
    t = F.upper("text")
    has = lambda word: F.contains(t, F.lit(word))
    marks = {"m_join": has("MERGE ON"), "m_stat": has("PROC MEANS"), "grouping": has("CLASS"), "reporting": has("PROC REPORT")}
    after = lambda words: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?:{words}) (?=(.{{0,{max(lengths, default=0)}}}))"), F.lit(1)))
    cut = lambda tails: F.array_distinct(F.flatten(F.transform(tails, lambda x: F.array(*[F.substring(x, 1, n) for n in lengths or [0]]))))
    read = scripts.select("id", *[c.alias(k) for k, c in marks.items()], cut(after("BY")).alias("by"), cut(after("CLASS|VAR")).alias("stat"))
    return read, known, bool(lengths)


def _classes() -> list[Column]:
    """join_key, statistical, grouping, reporting of a script's row of ``_key_words`` and a key."""
    joins, counts = F.col("m_join") | F.array_contains("by", F.col("key")), F.col("m_stat") | F.array_contains("stat", F.col("key"))
    return [joins.alias("join_key"), counts.alias("statistical"), F.col("grouping"), F.col("reporting")]


def variable_usage(scripts: DataFrame, names: DataFrame) -> DataFrame:
    """How scripts (id, text) use variables (name): id, name, join_key, statistical, grouping, reporting.

    A row for each name that a script has right after BY, CLASS or VAR, and a row with a null name for each
    script whose own words (MERGE ON, PROC MEANS, CLASS, PROC REPORT) mark whatever it uses; those marks are
    on its other rows as well. The cuts of what follows a key word are looked up. Case does not matter.
    """
    read, known, some = _key_words(scripts, names.where("name is not null"))
    own = read.where("m_join or m_stat or grouping or reporting").select(
        "id", F.lit(None).cast("string").alias("name"), F.col("m_join").alias("join_key"), F.col("m_stat").alias("statistical"), "grouping", "reporting"
    )
    if not some:
        return own
    each = read.withColumn("key", F.explode(F.array_union("by", "stat"))).select("id", "key", *_classes())
    return each.join(known, "key").select("id", "name", "join_key", "statistical", "grouping", "reporting").unionByName(own)


def variable_usage_pairs(scripts: DataFrame, names: DataFrame) -> DataFrame:
    """As ``variable_usage``, with a row for every script and every name, whatever its marks.

    The texts stay where they are read: only their marks and cuts meet the names. Marks of a null text are null,
    and those of a null name are what the script's own words say.
    """
    read, known, _ = _key_words(scripts, names)
    return read.crossJoin(known).select("id", "name", *_classes())
