"""Queries: dataset qualification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .registry import Registry

R = Registry()
q = R.query

# Orders with nulls and repeated rows; a catalog whose tables and names come from the data: brands and their parts' names.
_HOLES = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey > 10000 THEN NULL ELSE o_custkey END AS tail FROM orders"


def _holes(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("st"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(k <= 10000, F.col("o_custkey")).alias("tail")
    )


_CAT = "SELECT lower(p_brand) AS \"table\", lower(replace(p_name, ' ', '_')) AS name, CAST(min(p_partkey) AS BIGINT) AS position FROM part GROUP BY 1, 2"


def _catalog(t):
    return t.part.groupBy(F.lower("p_brand").alias("table"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")).agg(F.min("p_partkey").alias("position"))


_NAMES = "SELECT name, min(position) AS position FROM cat GROUP BY 1"
_WORDS = "SELECT DISTINCT lower(p_type) AS name FROM part"


def _names(t):
    return _catalog(t).groupBy("name").agg(F.min("position").alias("position"))


def _words(t):
    return t.part.select(F.lower("p_type").alias("name")).distinct()


@q(
    "q1_contents",
    "SELECT * FROM (VALUES (1, 'o_orderkey', 'bigint', 'numeric'), (2, 'o_orderdate', 'timestamp_ntz', 'datetime')) v(position, name, type, class), (SELECT CAST(count(*) AS BIGINT) AS n FROM orders)"
)
def _(t):
    return Q.contents(t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate")))


@q(
    "q2_check_schema",
    f"WITH cat AS ({_CAT}), want AS ({_WORDS}), w AS (SELECT DISTINCT \"table\", want.name FROM cat, want) SELECT coalesce(c.\"table\", w.\"table\") AS \"table\", coalesce(c.name, w.name) AS name, CASE WHEN c.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'extra' ELSE 'found' END AS status FROM cat c FULL JOIN w ON c.\"table\" = w.\"table\" AND c.name = w.name"
)
def _(t):
    return Q.check_schema(_catalog(t), _words(t))


@q(
    "q3_infer_key",
    "SELECT 1 AS rank, 'l_orderkey' AS columns, false AS is_key UNION ALL SELECT 2, 'l_orderkey,l_linenumber', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"
)
def _(t):
    return Q.infer_key(t.lineitem, [["l_orderkey"], ["l_orderkey", "l_linenumber"]])


@q(
    "q4_duplicate_rows",
    "SELECT CAST(2 * count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE o_orderkey % 10 = 0) AS BIGINT) AS duplicates, round(100.0 * count(*) FILTER (WHERE o_orderkey % 10 = 0) / (2 * count(*)), 6) AS percent FROM orders"
)
def _(t):
    k = F.col("o_orderkey")  # a second copy of all rows, nine in ten of them changed
    return Q.duplicates(t.orders.unionByName(t.orders.withColumn("o_orderkey", F.when(k % 10 == 0, k).otherwise(-k)))).withColumn("percent", F.round("percent", 6))


@q(
    "q5_duplicate_keys",
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates, round(100.0 * (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*), 6) AS percent FROM lineitem"
)
def _(t):
    return Q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]).withColumn("percent", F.round("percent", 6))


def _profile_sql(c):
    return f"SELECT '{c}' AS variable, CAST(count(*) - count({c}) AS BIGINT) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent FROM d"


@q(
    "q6_missing_profile",
    f"WITH d AS ({_HOLES}), p AS ({' UNION ALL '.join(map(_profile_sql, ['st', 'price', 'tail']))}) SELECT *, CASE WHEN percent > 50 THEN 'high' WHEN percent > 20 THEN 'medium' ELSE 'low' END AS criticality FROM p WHERE missing > 0"
)
def _(t):
    return Q.missing_profile(_holes(t)).withColumn("percent", F.round("percent", 6))


@q(
    "q7_missing_overall",
    f"WITH d AS ({_HOLES}) SELECT round(100.0 * (5 * count(*) - count(o_orderkey) - count(o_custkey) - count(st) - count(price) - count(tail)) / (5 * count(*)), 6) AS percent FROM d"
)
def _(t):
    return Q.missing_overall(_holes(t))


@q(
    "q8_missing_pattern",
    f"WITH d AS ({_HOLES}), p AS (SELECT 'price' AS variable, 100.0 * (count(*) - count(price)) / count(*) AS p, max(CASE WHEN price IS NOT NULL THEN o_orderkey END) < min(CASE WHEN price IS NULL THEN o_orderkey END) AS t FROM d UNION ALL SELECT 'tail', 100.0 * (count(*) - count(tail)) / count(*), max(CASE WHEN tail IS NOT NULL THEN o_orderkey END) < min(CASE WHEN tail IS NULL THEN o_orderkey END) FROM d) SELECT variable, round(p, 6) AS percent, CASE WHEN p = 0 THEN 'none' WHEN p = 100 THEN 'monotone' WHEN p > 50 THEN 'systematic' ELSE 'random' END AS pattern, p > 0 AND coalesce(t, false) AS tail_missing FROM p"
)
def _(t):
    return Q.missing_pattern(_holes(t), ["price", "tail"], "o_orderkey").withColumn("percent", F.round("percent", 6))


@q("q9_imputation_advice", f"WITH d AS ({_HOLES}), p AS ({_profile_sql('price')} UNION ALL {_profile_sql('tail')}) SELECT variable, 'keep' AS strategy FROM p")
def _(t):
    return Q.imputation_advice(Q.missing_pattern(_holes(t), ["price", "tail"], "o_orderkey")).select("variable", "strategy")


@q(
    "q10_handling_advice",
    "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN 'reject' WHEN o_orderkey % 100 >= 30 THEN 'leave_missing' WHEN o_orderstatus = 'F' THEN 'mode' ELSE 'mean' END AS strategy, CASE WHEN o_orderpriority LIKE '5%' THEN 'critical' WHEN o_orderkey % 100 > 50 THEN 'high' WHEN o_orderkey % 100 > 20 THEN 'medium' ELSE 'low' END AS criticality FROM orders"
)
def _(t):
    df = t.orders.select(
        "o_orderkey", (F.col("o_orderkey") % 100).alias("percent"), F.when(F.col("o_orderstatus") == "F", "CHAR").otherwise("num").alias("datatype"),
        F.when(F.col("o_orderpriority").like("5%"), "CLASS x").otherwise("PRINT").alias("usage")
    )
    return Q.handling_advice(df).select("o_orderkey", "strategy", "criticality")


@q(
    "q11_impute",
    f"WITH d AS ({_HOLES}) SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM d)), 6) AS price, round(coalesce(tail, (SELECT avg(tail) FROM d)), 6) AS tail FROM d"
)
def _(t):
    return Q.impute(
        _holes(t).withColumn("tail", F.col("tail").cast("double")), {"price": "median", "tail": "mean"}
    ).select("o_orderkey", F.round("price", 6).alias("price"), F.round("tail", 6).alias("tail"))


@q("q11_impute_by_group", f"WITH d AS ({_HOLES}) SELECT o_orderkey, round(coalesce(price, avg(price) OVER (PARTITION BY o_custkey)), 6) AS price FROM d")
def _(t):
    return Q.impute(_holes(t), {"price": "mean"}, "o_custkey").select("o_orderkey", F.round("price", 6).alias("price"))


@q("q12_impute_ordered", f"WITH d AS ({_HOLES}) SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS price FROM d")
def _(t):
    return Q.impute_ordered(_holes(t), "price", "o_custkey", "o_orderkey", "locf").select("o_orderkey", "price")


_HITS = "CAST(len([c for c in string_split({x}, '') if contains({y}, c)]) AS DOUBLE)"
_SIM = f"CASE WHEN r.name = f.name THEN 1.0 WHEN contains(f.name, r.name) OR contains(r.name, f.name) THEN 0.85 ELSE (CASE WHEN length(r.name) > length(f.name) THEN {_HITS.format(x='f.name', y='r.name')} ELSE {_HITS.format(x='r.name', y='f.name')} END) / greatest(length(r.name), length(f.name)) END"
_SIM1 = f"CASE WHEN r.name = f.name THEN 1.0 WHEN contains(f.name, r.name) OR contains(r.name, f.name) THEN 0.85 ELSE {_HITS.format(x='r.name', y='f.name')} / greatest(length(r.name), length(f.name)) END"
_MAP = f"WITH cat AS ({_CAT}), f AS ({_NAMES}), r AS ({_WORDS}), s AS (SELECT r.name AS required, f.name AS n, f.position, {_SIM} AS score, {_SIM1} AS first FROM f, r)"


@q(
    "q13_map_variables",
    f"{_MAP} SELECT required, arg_max(n, (round(score, 9), -position)) AS best, round(max(score), 6) AS score FROM s WHERE score > 0.7 AND required NOT IN (SELECT name FROM f) GROUP BY 1"
)
def _(t):
    return Q.map_variables(_names(t), _words(t)).withColumn("score", F.round("score", 6))


@q("q14_map_first", f"{_MAP} SELECT required, arg_min(n, position) AS match, round(arg_min(first, position), 6) AS score FROM s WHERE first > 0.7 GROUP BY 1")
def _(t):
    return Q.map_first(_names(t), _words(t)).withColumn("score", F.round("score", 6))


def _role_sql(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"""contains({name}, '{w}')""" for w in words)} THEN '{r}'" for r, words in Q.ROLES.items()) + " ELSE 'unknown' END"


def _pass_sql(i: int, pairs: str) -> str:
    """The pairs of a pass, each name once, and the names left."""
    return f"""p{i} AS (SELECT * FROM ({pairs})), o{i} AS (SELECT * FROM p{i} QUALIFY row_number() OVER (PARTITION BY required ORDER BY score DESC, position, n) = 1),
m{i} AS MATERIALIZED (SELECT required, n, score FROM o{i} QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, required) = 1),
f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} WHERE name NOT IN (SELECT n FROM m{i})), r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} WHERE name NOT IN (SELECT required FROM m{i}))"""


_PASSES = [
    "SELECT r.name AS required, f.name AS n, position, 1.0 AS score FROM f0 f JOIN r0 r ON f.name = r.name",
    f"SELECT * FROM (SELECT r.name AS required, f.name AS n, position, {_SIM} AS score FROM f1 f, r1 r) WHERE score > 0.75",
    f"SELECT r.name AS required, f.name AS n, position, 0.75 AS score FROM f2 f JOIN r2 r ON {_role_sql('r.name')} = {_role_sql('f.name')} AND {_role_sql('r.name')} <> 'unknown'",
]


@q(
    "q15_map_three_pass",
    f"WITH cat AS ({_CAT}), f0 AS ({_NAMES}), r0 AS (SELECT unnest(string_split(name, ' ')) AS name FROM ({_WORDS}) UNION SELECT 'dose_' || name FROM ({_WORDS}) UNION SELECT p || CAST(length(name) AS VARCHAR) FROM ({_WORDS}), (VALUES ('age'), ('visit')) v(p)), {', '.join(_pass_sql(i + 1, p) for i, p in enumerate(_PASSES))} " + " UNION ALL ".join(
        f"SELECT required, n AS match, CAST(round(score, 6) AS DOUBLE) AS score, '{how}' AS how FROM m{i + 1}" for i, how in enumerate(("exact", "fuzzy", "role"))
    )
)
def _(t):
    w = _words(t)
    more = w.select(F.explode(F.split("name", " ")).alias("name")).union(w.select(F.concat(F.lit("dose_"), "name"))).union(
        w.select(F.explode(F.array(*[F.concat(F.lit(p), F.length("name").cast("string")) for p in ("age", "visit")])))
    )
    return Q.map_three_pass(_names(t), more.distinct()).withColumn("score", F.round("score", 6))


_W1 = "SELECT doc_id, lower(regexp_extract(text, '^[A-Za-z]+')) AS w FROM documents"


def _first_word(t):
    return t.documents.select("doc_id", F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("w"))


def _has(words):
    return "(" + " OR ".join(f"contains(w, '{x}')" for x in words) + ")"


@q("q16_variable_role", f"WITH d AS ({_W1}) SELECT doc_id, CASE " + " ".join(f"WHEN {_has(w)} THEN '{r}'" for r, w in Q.ROLES.items()) + " ELSE 'unknown' END AS role FROM d")
def _(t):
    return _first_word(t).select("doc_id", Q.role(F.col("w")).alias("role"))


# A catalog of sources and the words of their documents' beginnings.
_SRC = "SELECT DISTINCT source AS \"table\", lower(u.w) AS name FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) u"


def _sources(t):
    words = t.documents.select(F.col("source").alias("table"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return words.select("table", F.lower("w").alias("name")).distinct()


@q(
    "q17_classify",
    f"WITH c AS ({_SRC}), a AS (SELECT \"table\", count(DISTINCT name) FILTER (WHERE name IN ('usubjid', 'visit', 'visitnum', 'visitdat')) AS s, count(DISTINCT name) FILTER (WHERE name IN ('usubjid', 'ady', 'avisit', 'avisitn')) AS d, count(DISTINCT name) FILTER (WHERE name IN ('table', 'figure', 'listing', 'page')) AS f, bool_or(contains(name, 'usubjid') OR contains(name, 'visit') OR contains(name, 'avisit') OR contains(name, 'ady') OR contains(name, 'dmy')) AS k FROM c GROUP BY 1), b AS (SELECT \"table\", round(s / 4 * 0.4 + k::INT * 0.1, 6) AS s, round(d / 4 * 0.4 + k::INT * 0.1, 6) AS d, round(f / 4 * 0.4, 6) AS f FROM a) SELECT \"table\", CASE WHEN greatest(s, d, f) = 0 THEN 'Unknown' WHEN s >= d AND s >= f THEN 'SDTM' WHEN d >= f THEN 'ADaM' ELSE 'TLF' END AS class, greatest(s, d, f) AS score FROM b"
)
def _(t):
    return Q.classify(_sources(t))


@q(
    "q18_classify_by_prefix",
    f"WITH c AS ({_SRC}) SELECT \"table\", CASE WHEN bool_or(starts_with(name, 'ae')) THEN 'SDTM' WHEN bool_or(contains(name, 'ady') OR contains(name, 'aval')) THEN 'ADaM' WHEN bool_or(contains(name, 'table') OR contains(name, 'figure')) THEN 'TLF' ELSE 'Raw' END AS class FROM c GROUP BY 1"
)
def _(t):
    return Q.classify_by_prefix(_sources(t))


@q("q19_dataset_role", f"WITH d AS ({_W1}) SELECT doc_id, CASE " + " ".join(f"WHEN {_has(w)} THEN '{r}'" for w, r in Q.DATASET_ROLES) + " ELSE 'Unknown' END AS role FROM d")
def _(t):
    return _first_word(t).select("doc_id", Q.dataset_role(F.col("w")).alias("role"))


@q(
    "q20_importance",
    f"WITH d AS ({_W1}) SELECT CASE WHEN {_has(Q.CRITICAL)} THEN 'critical' WHEN {_has(Q.IMPORTANT)} THEN 'important' ELSE 'optional' END AS importance, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1"
)
def _(t):
    return _first_word(t).groupBy(Q.importance(F.col("w")).alias("importance")).agg(F.count(F.lit(1)).alias("n"))


_FACTS = "SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS required, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS extra, CAST(count(*) FILTER (WHERE o_totalprice > 300000) AS BIGINT) AS high_missing, CAST(o_custkey % 70 AS BIGINT) AS pct FROM orders GROUP BY o_custkey"


def _facts(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("required"), F.count_if(s == "F").alias("missing"), F.count_if(s == "O").alias("extra"),
        F.count_if(F.col("o_totalprice") > 300000).alias("high_missing")
    ).withColumn("pct", F.col("id") % 70)


@q(
    "q21_score_a",
    f"WITH f AS ({_FACTS}), s AS (SELECT id, greatest(0, least(100, 100 - 5 * missing - 2 * extra)) AS a, greatest(0, 100 - 100.0 * missing / (required + missing)) AS b, 100 - least(50, pct) AS c, greatest(0, 80 - 10 * high_missing) AS d, 100 - 0.5 * pct AS e FROM f) SELECT id, CASE WHEN (a + b + c + d + e) / 5 >= 90 THEN 'accepted' WHEN (a + b + c + d + e) / 5 >= 70 THEN 'accepted_with_warning' WHEN (a + b + c + d + e) / 5 >= 50 THEN 'needs_review' ELSE 'rejected' END AS decision, round(b, 6) AS variables FROM s"
)
def _(t):
    f = _facts(t).withColumns({"duplicate_percent": F.col("pct"), "clinical": F.lit(True), "average_missing": F.col("pct")})
    return Q.score_a(f).select("id", "decision", F.round("variables", 6).alias("variables"))


@q(
    "q23_score_b",
    f"WITH f AS ({_FACTS}), s AS (SELECT id, pct, missing > 2 AS dup, (100 + 100.0 * (required - missing) / required + 95 + 90 + 85 + 100 - pct) / 6 AS o FROM f) SELECT id, o >= 80 AS ready, dup::INT + (pct > 30)::INT AS issues, (pct > 20)::INT + dup::INT AS advice, CASE WHEN o < 80 THEN 'needs_review' WHEN dup OR pct > 30 THEN 'accepted_with_warning' ELSE 'accepted' END AS status FROM s"
)
def _(t):
    f = _facts(t).withColumns({"columns": F.lit(9), "found": F.col("required") - F.col("missing"), "missing_percent": F.col("pct"), "has_duplicates": F.col("missing") > 2})
    return Q.score_b(f).select("id", "ready", "issues", "advice", "status")


@q("q24_score_c", f"WITH f AS ({_FACTS}) SELECT id, CASE WHEN id % 5 = 0 THEN true ELSE (100 - 5 * extra + 100.0 * (required - missing) / required + 90 + 85) / 4 >= 80 END AS ready FROM f")
def _(t):
    return Q.score_c(_facts(t).withColumn("has_schema", F.col("id") % 5 != 0)).select("id", "ready")


@q("q25_readable", "SELECT CAST(count(*) AS BIGINT) AS rows, true AS readable, true AS types_ok, true AS structure_ok, 'accepted' AS status FROM events")
def _(t):
    return Q.readable(t.events)


@q(
    "q26_schema_score",
    f"{_MAP} SELECT round(100.0 * (SELECT count(*) FROM (SELECT required, arg_min(first, position) AS f FROM s WHERE first > 0.7 GROUP BY 1) WHERE f > 0.8) / (SELECT count(*) FROM r), 6) AS schema_score"
)
def _(t):
    return Q.schema_score(Q.map_first(_names(t), _words(t)), _words(t)).withColumn("schema_score", F.round("schema_score", 6))


@q(
    "q27_match_datasets",
    f"WITH c AS ({_SRC}), a AS (SELECT \"table\", bool_or(name IN ('age', 'sex', 'race', 'weight')) AS d, count(*) AS k FROM c GROUP BY 1), e AS (SELECT DISTINCT 'x' || source AS expected FROM documents), s AS (SELECT expected, \"table\", round(CASE WHEN contains(\"table\", expected) OR contains(expected, \"table\") THEN 0.3 ELSE 0.0 END + CASE WHEN d THEN 0.1 ELSE 0.0 END + CASE WHEN k > 5 THEN 0.2 ELSE 0.0 END, 6) AS confidence FROM a, e) SELECT * FROM s WHERE confidence > 0.4"
)
def _(t):
    expected = t.documents.select(F.concat(F.lit("x"), "source").alias("expected"), F.lit("outcome").alias("role")).distinct()
    return Q.match_datasets(expected, _sources(t), 0.4)


@q(
    "q28_missing_required",
    f"WITH c AS (SELECT \"table\", CASE WHEN length(name) > 6 THEN '_' || name ELSE name END AS name FROM ({_SRC})), u AS (SELECT source AS \"table\", lower(regexp_extract(text, '^[A-Za-z]+')) AS variable, CASE WHEN doc_id % 3 = 0 THEN 'MEANS' ELSE 'DATA' END || (doc_id % 7) AS step FROM documents) SELECT u.\"table\", variable, CAST(count(DISTINCT step) AS BIGINT) AS uses, CASE WHEN count(DISTINCT step) > 2 THEN 'critical' WHEN bool_or(contains(step, 'MEANS')) THEN 'high' ELSE 'medium' END AS severity FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.\"table\" = u.\"table\" AND c.name = u.variable) GROUP BY 1, 2"
)
def _(t):
    step = F.concat(F.when(F.col("doc_id") % 3 == 0, "MEANS").otherwise("DATA"), (F.col("doc_id") % 7).cast("string"))
    usage = t.documents.select(F.col("source").alias("table"), F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("variable"), step.alias("step"))
    have = _sources(t).withColumn("name", F.when(F.length("name") > 6, F.concat(F.lit("_"), "name")).otherwise(F.col("name")))  # the whole catalog, its long words under names that no text begins with
    return Q.missing_required(usage, have)


@q(
    "q29_quality_dimensions",
    f"WITH d AS ({_HOLES}) SELECT 'completeness' AS dimension, round(100 - 100.0 * (5 * count(*) - count(o_orderkey) - count(o_custkey) - count(st) - count(price) - count(tail)) / (5 * count(*)), 6) AS percent FROM d UNION ALL SELECT 'validity', round(100.0 * count(*) FILTER (WHERE price > 1000) / count(*), 6) FROM d UNION ALL SELECT 'uniqueness', 100.0"
)
def _(t):
    return Q.quality_dimensions(_holes(t), {"validity": F.col("price") > 1000}).withColumn("percent", F.round("percent", 6))


@q(
    "q30_compliance",
    f"WITH cat AS ({_CAT}), want AS ({_WORDS}) SELECT \"table\", (SELECT CAST(count(*) AS BIGINT) FROM want) AS expected, CAST(count(*) FILTER (WHERE name IN (SELECT name FROM want)) AS BIGINT) AS found, round(100.0 * count(*) FILTER (WHERE name IN (SELECT name FROM want)) / (SELECT count(*) FROM want), 4) AS percent FROM cat GROUP BY 1"
)
def _(t):
    return Q.compliance(_catalog(t), _words(t))


_AS = lambda word: f"contains(upper(text), '{word} ' || upper(p_type))"


@q(
    "q31_variable_usage",
    f"SELECT doc_id AS id, lower(p_type) AS name, {_AS('BY')} OR contains(upper(text), 'MERGE ON') AS join_key, {_AS('CLASS')} OR {_AS('VAR')} OR contains(upper(text), 'PROC MEANS') AS statistical, contains(upper(text), 'CLASS') AS grouping, contains(upper(text), 'PROC REPORT') AS reporting FROM documents, (SELECT DISTINCT p_type FROM part)"
)
def _(t):
    types = t.part.select(F.col("p_type").alias("name")).distinct()
    return Q.variable_usage_pairs(t.documents.select(F.col("doc_id").alias("id"), "text"), types).withColumn("name", F.lower("name"))


# the second words of all texts, looked for in all texts
_USED = """n AS (SELECT DISTINCT split_part(text, ' ', 2) AS name FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, upper(text) AS u FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, contains(u, 'MERGE ON') AS a, contains(u, 'PROC MEANS') AS b, contains(u, 'CLASS') AS grouping, contains(u, 'PROC REPORT') AS reporting FROM d)"""


@q("q31_variable_usage_found", f"""WITH {_USED}, h AS (SELECT doc_id AS id, name, a OR contains(u, 'BY ' || upper(name)) AS join_key, b OR contains(u, 'CLASS ' || upper(name)) OR contains(u, 'VAR ' || upper(name)) AS statistical, grouping, reporting, contains(u, 'BY ' || upper(name)) OR contains(u, 'CLASS ' || upper(name)) OR contains(u, 'VAR ' || upper(name)) AS hit FROM m, n)
SELECT id, name, join_key, statistical, grouping, reporting FROM h WHERE hit UNION ALL SELECT doc_id, NULL, a, b, grouping, reporting FROM m WHERE a OR b OR grouping OR reporting""")
def _(t):
    words = t.documents.select(F.split_part("text", F.lit(" "), F.lit(2)).alias("name"))
    return Q.variable_usage(t.documents.select(F.col("doc_id").alias("id"), "text"), words)
