"""Analytics over a table of programs (id, text): counts, scores, dependencies, lineage, readiness.

Programs are searched by patterns, row by row; edges and lists are ordinary tables from there on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .program_tables import COMPLEXITY, CREATED, DEMO, DOMAINS, FEATURES, GOALS, INPUTS, NOT_CLINICAL, PAIRED, PENALTIES, SEVEN, TIERS
from .storage import drop, staged

def _count(u: Column, pattern: str) -> Column:
    return F.regexp_count(u, F.lit(pattern))


def _has(u: Column, pattern: str) -> Column:
    return F.rlike(u, F.lit(pattern)).cast("int")


def _procs(u: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(u, F.lit(r"\bPROC\s+(\w+)"), F.lit(1)), F.lower))


def _points(procs: Column, table: dict[str, int], default: int) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.aggregate(procs, F.lit(0), lambda a, p: a + F.coalesce(F.try_element_at(known, p), F.lit(default)))


def construct_counts(scripts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """id and a count for each named pattern, in either case."""
    return scripts.select("id", *[F.regexp_count("text", F.lit(f"(?i){p}")).alias(k) for k, p in patterns.items()])


def rule_points(rules: list[tuple], text: Column) -> Column:
    """Sum of the points that rules give a program; a fourth entry is a rule's limit.

    "each": points for every match; "beyond the first": for every match but one; "each but definitions": for every match
    less the macro definitions; "distinct": for every different match ("as written": without regard to upper case); "hit",
    "several", "exactly one", "over": once for a match, for two different ones, for a single one, for more than the limit
    over several patterns; "word", "words", "without": once if one, all, none of the words occur; "procedure": once if one
    of the procedures occurs; "procedures": by a table, with the points for those that it has not; "no procedure": once.
    """
    u = F.upper(text)
    procs = _procs(u)
    different = lambda t, p: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0))))
    held = lambda words: [F.contains(u, F.lit(w)) for w in words]
    some = lambda words: reduce(lambda a, b: a | b, held(words))
    amounts = {
        "each": lambda p: _count(u, p), "beyond the first": lambda p: F.greatest(_count(u, p) - 1, F.lit(0)), "each but definitions": lambda p: _count(u, p) - _count(u, r"%MACRO\b"),
        "distinct": lambda p: different(u, p), "distinct as written": lambda p: different(text, p),
    }
    conditions = {
        "hit": lambda p: F.rlike(u, F.lit(p)), "several": lambda p: different(u, p) > 1, "exactly one": lambda p: _count(u, p) == 1, "word": some, "without": lambda words: ~some(words),
        "words": lambda words: reduce(lambda a, b: a & b, held(words)), "procedure": lambda names: F.arrays_overlap(procs, F.array(*map(F.lit, names))), "no procedure": lambda _: F.size(procs) == 0,
    }

    def one(kind: str, what, points: int, limit: int | None = None) -> Column:
        if kind == "over":
            return F.when(reduce(lambda a, b: a + b, [_count(u, p) for p in what]) > limit, points).otherwise(0)
        if kind in conditions:
            return F.when(conditions[kind](what), points).otherwise(0)
        out = _points(procs, what, points) if kind == "procedures" else amounts[kind](what) * points
        return out if limit is None else F.least(out, F.lit(limit))

    return reduce(lambda a, b: a + b, [one(*r) for r in rules])


def complexity(scripts: DataFrame) -> DataFrame:
    """id, score (at most 100), level, level_name by weighted constructs."""
    scored = scripts.select("id", F.least(rule_points(COMPLEXITY, F.col("text")), F.lit(100)).alias("score"))
    return scored.select("id", "score", level(F.col("score")).alias("level"), level_name(level(F.col("score"))).alias("level_name"))


def level(score: Column) -> Column:
    """1 to 5, by twenties."""
    return F.when(score <= 20, 1).when(score <= 40, 2).when(score <= 60, 3).when(score <= 80, 4).otherwise(5)


def level_name(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ["Basic", "Simple", "Intermediate", "Advanced Clinical", "Enterprise"])), n)


def seven_dimensions(scripts: DataFrame) -> DataFrame:
    """id, the seven capped scores, bonus, penalty and total (0 to 100)."""
    dims = [F.least(rule_points(rules, F.col("text")), F.lit(most)).alias(name) for name, (most, rules) in SEVEN.items()]
    out = scripts.select("id", *dims, rule_points(PENALTIES, F.col("text")).alias("p"))
    out = out.select("id", *SEVEN, (F.col("p") + F.when(F.col("clinical") == 0, NOT_CLINICAL).otherwise(0)).alias("penalty"))
    total = reduce(lambda a, b: a + b, [F.col(k) for k in SEVEN]) - F.col("penalty")
    return out.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), total)))


def tiers(scripts: DataFrame) -> DataFrame:
    """id, score, tier: the first hit of each feature counts."""
    u = F.upper("text")
    score = reduce(lambda a, b: a + b, [_has(u, p) * w for p, w in FEATURES] + [(F.rlike(u, F.lit(a)) & F.rlike(u, F.lit(b))).cast("int") * w for (a, b), w in PAIRED])
    tier = F.lit(1)
    for least, t in reversed(TIERS):
        tier = F.when(F.col("score") >= least, t).otherwise(tier)
    return scripts.select("id", score.alias("score")).withColumn("tier", tier)


def edges(scripts: DataFrame) -> DataFrame:
    """id, dataset, kind (required or created), distinct and in lower case."""
    u = F.upper("text")
    lists = [
        F.transform(
            F.regexp_extract_all(u, F.lit(p), F.lit(1)), lambda x: F.struct(F.lower(x).alias("dataset"), F.lit(k).alias("kind"))
        ) for k, p in (("required", INPUTS), ("created", CREATED))
    ]
    return scripts.select("id", F.inline(F.concat(*lists))).where(~F.col("dataset").startswith("_")).distinct()


def external_inputs(e: DataFrame) -> DataFrame:
    """id, dataset: required and never created by the same program."""
    made = e.where("kind = 'created'").select("id", "dataset")
    return e.where("kind = 'required'").select("id", "dataset").join(made, ["id", "dataset"], "left_anti")


def self_contained(e: DataFrame) -> DataFrame:
    """id, self_contained: whether a program needs no external input."""
    outside = external_inputs(e).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return e.select("id").distinct().join(outside, "id", "left").select("id", F.col("k").isNull().alias("self_contained"))


def lineage_roles(e: DataFrame) -> DataFrame:
    """id, dataset, role: source (only required), output (only created), intermediate (both)."""
    r, c = F.bool_or(F.col("kind") == "required"), F.bool_or(F.col("kind") == "created")
    return e.groupBy("id", "dataset").agg(F.when(r & c, "intermediate").when(r, "source").otherwise("output").alias("role"))


def _base(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def similar_name(a: Column, b: Column) -> Column:
    """Equal or one within the other after the library prefix, or within two letters."""
    x, y = _base(a), _base(b)
    differ = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p.isNotNull() & q.isNotNull(), p != q)), lambda d: F.coalesce(d, F.lit(False))))
    return F.contains(x, y) | F.contains(y, x) | ((F.abs(F.length(x) - F.length(y)) <= 2) & (differ <= 2))


def upload_decisions(e: DataFrame) -> DataFrame:
    """id, dataset, upload (true for sources), alternatives: created names of the program that look alike."""
    roles = lineage_roles(e)
    sources, made = roles.where("role = 'source'"), e.where("kind = 'created'").select("id", F.col("dataset").alias("made"))
    alike = sources.join(made, "id").where(similar_name(F.col("dataset"), F.col("made"))).groupBy("id", "dataset").agg(F.sort_array(F.collect_set("made")).alias("alternatives"))
    return roles.join(alike, ["id", "dataset"], "left").select(
        "id", "dataset", (F.col("role") == "source").alias("upload"),
        F.array_join(F.coalesce("alternatives", F.array().cast("array<string>")), ",").alias("alternatives")
    )


def step_edges(scripts: DataFrame) -> DataFrame:
    """id, src, dst: datasets that a DATA step reads and writes, one row per pair."""
    steps = scripts.select("id", F.explode(F.regexp_extract_all(F.upper("text"), F.lit(r"(?s)\bDATA\s+[A-Z_][\w.]*\s*;.*?\bRUN\s*;"), F.lit(0))).alias("step"))
    dst = F.lower(F.regexp_extract("step", r"\bDATA\s+([A-Z_][\w.]*)", 1))
    return steps.select(
        "id", F.explode(F.transform(F.regexp_extract_all("step", F.lit(r"\b(?:SET|MERGE|UPDATE|MODIFY)\s+([A-Z_][\w.]*)"), F.lit(1)), F.lower)).alias("src"),
        dst.alias("dst")
    ).distinct()


def dependency_depth(steps: DataFrame) -> DataFrame:
    """id, dataset, depth: the longest chain of steps before a dataset; null where a cycle of two or more datasets is among them.

    Datasets without open inputs are peeled off, with the steps that they begin; each round works on what its predecessor
    opened and on the steps left. There are as many rounds as the longest chain has datasets; what is never opened is in or behind a cycle.
    """
    nodes = steps.select("id", F.col("src").alias("dataset")).union(steps.select("id", "dst")).distinct()
    left = staged(steps.where("src <> dst").select("id", "src", "dst").distinct(), "steps")
    opened = [staged(nodes.join(left.select("id", F.col("dst").alias("dataset")), ["id", "dataset"], "left_anti").withColumn("depth", F.lit(0)), "open")]
    while not left.isEmpty():
        last = opened[-1].select("id", F.col("dataset").alias("src"))
        rest = staged(left.join(last, ["id", "src"], "left_anti").select("id", "src", "dst"), "steps")
        begun = left.join(last, ["id", "src"], "left_semi").select("id", F.col("dst").alias("dataset")).distinct()
        new = staged(begun.join(rest.select("id", F.col("dst").alias("dataset")), ["id", "dataset"], "left_anti").withColumn("depth", F.lit(len(opened))), "open")
        if new.isEmpty():
            break
        opened.append(new)
        drop(left)
        left = rest
    return nodes.join(reduce(DataFrame.unionByName, opened), ["id", "dataset"], "left").select("id", "dataset", "depth")


def self_cycles(steps: DataFrame) -> DataFrame:
    return steps.where("src = dst").select("id", F.col("src").alias("dataset"))


def readiness(e: DataFrame, uploaded: DataFrame, execution: float = 70.0) -> DataFrame:
    """id, required, missing, data, intent, overall, ready, health and risk per program; ``uploaded``: table of dataset names."""
    need = external_inputs(e).join(uploaded.select("dataset").distinct().withColumn("u", F.lit(1)), "dataset", "left")
    need = need.groupBy("id").agg(F.count(F.lit(1)).alias("required"), F.count_if(F.col("u").isNull()).alias("missing"))
    out = e.select("id").distinct().join(need, "id", "left").na.fill(0, ["required", "missing"])
    data = F.when(F.col("required") == 0, 100.0).otherwise(100.0 * (F.col("required") - F.col("missing")) / F.col("required"))
    out = out.withColumn("data", data).withColumn("intent", F.lit(100.0))
    overall = F.when(F.col("data") == 100, 100.0).otherwise(F.round(0.5 * F.col("data") + 0.3 * F.col("intent") + 0.2 * execution, 1))
    health = F.when(F.col("data") > 90, "Excellent").when(F.col("data") > 75, "Good").when(F.col("data") > 50, "Fair").otherwise("Poor")
    risk = F.when(F.col("missing") > F.col("required") * 0.3, "HIGH").when(F.col("missing") > 0, "MEDIUM").otherwise("LOW")
    return out.withColumns({"overall": overall, "health": health, "risk": risk}).withColumn("ready", F.col("overall") >= 80)


def impact_scores(scripts: DataFrame) -> DataFrame:
    """id, parser, packages: sub-scores by macros and procedures without a ready counterpart."""
    u = F.upper("text")
    hard = F.size(F.filter(F.regexp_extract_all(u, F.lit(r"PROC\s+(\w+)"), F.lit(1)), lambda p: p.isin("LOGISTIC", "GENMOD", "MIXED", "GLIMMIX")))
    return scripts.select("id", F.when(F.contains(u, F.lit("%MACRO")), 80).otherwise(90).alias("parser"), F.greatest(F.lit(0), 80 - 10 * hard).alias("packages"))


def upload_priority(missing: DataFrame) -> DataFrame:
    """id, step, dataset, priority for rows (id, dataset, upload: true, false or conditional)."""
    rank = F.when(F.col("upload") == "true", 1).when(F.col("upload") == "conditional", 2).otherwise(3)
    named = missing.withColumn("r", rank).withColumn("priority", F.element_at(F.array(F.lit("CRITICAL"), F.lit("CONDITIONAL"), F.lit("OPTIONAL")), F.col("r")))
    return named.select("id", F.row_number().over(Window.partitionBy("id").orderBy("r", "dataset")).alias("step"), "dataset", "priority")


def domain(scripts: DataFrame) -> DataFrame:
    """id, domain, confidence by keyword hits; two are needed, demonstrations are general; ties go to the earlier domain."""
    split = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"))
    listed = lambda words: F.array(*map(F.lit, words))
    words = scripts.select("id", split(F.col("text")).alias("words"), split(F.left(F.col("text"), F.lit(200))).alias("start"))
    best = F.array_max(F.array(*[F.struct(F.col(d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DOMAINS)]))
    out = words.select("id", *[F.size(F.array_intersect("words", listed(s))).alias(d) for d, s in DOMAINS.items()], F.arrays_overlap("start", listed(DEMO)).alias("demo"))
    general = F.when(F.col("demo") & (F.col("clinical") < 3), 0.6).when(best["n"] == 0, 0.5).when(best["n"] < 2, 0.4)
    return out.select("id", F.when(general.isNotNull(), "general").otherwise(best["d"]).alias("domain"), F.coalesce(general, F.least(best["n"] / 5, F.lit(1.0))).alias("confidence"))


def goals(scripts: DataFrame) -> DataFrame:
    """id, primary, goals: tags whose pattern occurs, in the order of the table; data_analysis if none does."""
    found = F.filter(F.array(*[F.when(F.rlike("text", F.lit(f"(?is){'|'.join(ps)}")), F.lit(g)) for g, ps in GOALS.items()]), lambda g: g.isNotNull())
    found = F.when(F.size(found) == 0, F.array(F.lit("data_analysis"))).otherwise(found)
    return scripts.select("id", found[0].alias("primary"), F.array_join(found, ",").alias("goals"))


def complexity_class(score: Column) -> Column:
    return F.when(score <= 5, "simple").when(score <= 12, "moderate").when(score <= 20, "complex").otherwise("highly_complex")


def macro_variables(scripts: DataFrame) -> DataFrame:
    """id, used, unresolved: names of macro variables, and those that no %let or parameter list defines."""
    t = F.lower("text")
    used = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&([a-z_]\w*)"), F.lit(1)))
    given = F.concat(
        F.regexp_extract_all(t, F.lit(r"%let\s+([a-z_]\w*)"), F.lit(1)),
        F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"%macro\s+\w+\s*\(([^)]*)\)"), F.lit(1)), lambda p: F.split(F.replace(p, F.lit(" "), F.lit("")), ",")))
    )
    return scripts.select("id", F.array_join(F.sort_array(used), ",").alias("used"), F.array_join(F.sort_array(F.array_except(used, given)), ",").alias("unresolved"))


def inventory(scripts: DataFrame, equivalents: DataFrame) -> DataFrame:
    """id, name, uses, equivalent: calls ``name(`` of a program joined to a mapping table (name, equivalent)."""
    calls = scripts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z_]\w*)\("), F.lit(1))).alias("name"))
    return calls.groupBy("id", "name").agg(F.count(F.lit(1)).alias("uses")).join(equivalents, "name", "left").select("id", "name", "uses", "equivalent")


def lint(scripts: DataFrame) -> DataFrame:
    """id, line, issue: semicolon (a bare RUN, QUIT, …), comment (//), blanks at the end."""
    lines = scripts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "s"))
    bare = F.upper(F.trim("s")).isin("RUN", "QUIT", "DATA", "PROC SORT")
    found = F.filter(
        F.array(F.when(bare, F.lit("semicolon")), F.when(F.startswith(F.trim("s"), F.lit("//")), F.lit("comment")), F.when(F.rlike("s", F.lit("[ \\t]+$")), F.lit("trailing_blanks"))),
        lambda x: x.isNotNull()
    )
    return lines.select("id", (F.col("at") + 1).alias("line"), F.explode(found).alias("issue"))


def balance(scripts: DataFrame) -> DataFrame:
    """id, do_end, parentheses: surplus of openings over closings."""
    u = F.upper("text")
    return scripts.select("id", (_count(u, r"\bDO\b") - _count(u, r"\bEND\b")).alias("do_end"), (_count(u, r"\(") - _count(u, r"\)")).alias("parentheses"))


def line_counts(scripts: DataFrame) -> DataFrame:
    """id, lines that are not blank."""
    return scripts.select("id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))


def match_names(required: DataFrame, files: DataFrame) -> DataFrame:
    """id, satisfied, total: required dataset names found among file names, without library prefix and suffix."""
    have = files.select(F.regexp_replace(F.lower("file"), r"\.[a-z0-9]+$", "").alias("b")).distinct().withColumn("f", F.lit(1))
    return required.withColumn("b", _base(F.col("dataset"))).join(have, "b", "left").groupBy("id").agg(F.count("f").alias("satisfied"), F.count(F.lit(1)).alias("total"))
