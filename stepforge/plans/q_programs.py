"""Queries: comparison, clinical derivations, analytics over programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical as D
from ..operators import compare as C
from ..operators import program_tables as T
from ..operators import programs as K
from .registry import Registry

R = Registry()
q = R.query

# orders against a changed copy, one in eleven under another key
_B = "(SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.5 * o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders)"


def _ab(t):
    a = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    changed = {"o_totalprice": F.when(k % 7 == 0, F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice")), "o_orderkey": F.when(k % 11 == 0, -k).otherwise(k)}
    return a, a.withColumns(changed)


@q(
    "c1_compare_shape",
    f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders) AS rows_a, (SELECT CAST(count(*) AS BIGINT) FROM {_B}) AS rows_b, 4 AS columns_a, 4 AS columns_b, (SELECT count(*) FROM orders) = (SELECT count(*) FROM {_B}) AS equal"
)
def _(t):
    return C.compare_shape(*_ab(t))


_OUT = "CAST(count(*) FILTER (WHERE b.o_orderkey IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE a.o_orderkey IS NULL) AS BIGINT) AS only_b FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey"


@q(
    "c2_compare_cells",
    f"WITH b AS {_B} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {same}) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE NOT ({same})) AS BIGINT) AS differing, {_OUT}" for c, same in (
            ("o_custkey", "a.o_custkey = b.o_custkey"), ("o_orderstatus", "a.o_orderstatus = b.o_orderstatus"),
            ("o_totalprice", "abs(a.o_totalprice - b.o_totalprice) <= 1e-4 * greatest(1, abs(a.o_totalprice))")
        )
    )
)
def _(t):
    return C.compare(*_ab(t), "o_orderkey")


@q(
    "c3_numeric_agreement",
    f"WITH b AS {_B} SELECT round(100.0 * count(*) FILTER (WHERE abs(a.o_totalprice - b.o_totalprice) <= 1e-4 * greatest(1, abs(a.o_totalprice))) / count(*), 4) AS match_percent, 'warning' AS status FROM orders a JOIN b USING (o_orderkey)"
)
def _(t):
    a, b = _ab(t)
    both = a.join(b.select("o_orderkey", F.col("o_totalprice").alias("other")), "o_orderkey")
    return both.agg(*C.agreement(F.col("o_totalprice"), F.col("other")))


_NUM = "regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')"
_DOCNUM = f"SELECT doc_id AS id, unnest(range(len(v))) AS position, unnest(v) AS number FROM (SELECT doc_id, [TRY_CAST(x AS DOUBLE) for x in {_NUM} if abs(TRY_CAST(x AS DOUBLE)) < 1e15] AS v FROM documents)"


@q(
    "c4_text_agreement",
    f"WITH x AS ({_DOCNUM}) SELECT id, CAST(count(*) AS BIGINT) AS pairs, round(100.0 * avg(CASE WHEN abs(x.number - CASE WHEN position % 4 = 0 THEN x.number + 1 ELSE x.number END) <= 1e-4 * greatest(1, abs(x.number)) THEN 1 ELSE 0 END), 4) AS match_percent, CASE WHEN 100.0 * avg(CASE WHEN position % 4 = 0 AND 1 > 1e-4 * greatest(1, abs(x.number)) THEN 0 ELSE 1 END) >= 95 THEN 'passed' ELSE 'warning' END AS status FROM x GROUP BY 1"
)
def _(t):
    docs = t.documents.select("doc_id", "text")
    n = C.numbers(docs, "doc_id", "text")
    changed = n.withColumn("number", F.when(F.col("position") % 4 == 0, F.col("number") + 1).otherwise(F.col("number")))
    other = changed.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.format_string("%.9f", "number").alias("s")))).alias("v")
    ).select(F.col("id").alias("doc_id"), F.array_join(F.transform("v", lambda x: x["s"]), " ").alias("text"))
    return C.text_agreement(docs, other, "doc_id", "text")


@q("c5_first_numbers", f"WITH x AS ({_DOCNUM}) SELECT id, CAST(count(*) AS BIGINT) AS pairs, 100.0 AS match_percent, 'passed' AS status FROM x WHERE position < 20 GROUP BY 1")
def _(t):
    docs = t.documents.select("doc_id", "text")
    return C.text_agreement(docs, docs, "doc_id", "text", first=20, tol=1e-2, passed=80, warning=60)


@q(
    "c6_output_shapes",
    "SELECT 'orders' AS dataset, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS rows, 6 AS columns UNION ALL SELECT 'nation', (SELECT CAST(count(*) AS BIGINT) FROM nation), 3"
)
def _(t):
    return C.output_shapes({"orders": t.orders, "nation": t.nation})


# validation records out of line items: an order is a run, its lines are scenarios
_SC = "SELECT l_orderkey AS run, (['structural', 'functional', 'statistical', 'execution', 'semantic'])[l_linenumber % 5 + 1] AS category, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'warning' ELSE 'passed' END AS status, l_quantity AS impact FROM lineitem"


def _scenarios(t):
    cat = F.element_at(F.array(*map(F.lit, C.WEIGHTS)), F.col("l_linenumber") % 5 + 1)
    s = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "warning").otherwise("passed")
    return t.lineitem.select(
        F.col("l_orderkey").alias("run"), cat.alias("category"), s.alias("status"), F.col("l_quantity").alias("impact"), F.col("l_linestatus").alias("section"),
        F.concat(F.lit("Line "), "l_linenumber").alias("message")
    )


_CARD = f"SELECT run, category, round(100.0 * sum(CASE status WHEN 'passed' THEN impact WHEN 'warning' THEN impact / 2 ELSE 0 END) / sum(impact), 1) AS score, CAST(count(*) FILTER (WHERE status = 'passed') AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total FROM ({_SC}) GROUP BY 1, 2"
_FULL = f"WITH c AS ({_CARD}), f AS (SELECT DISTINCT run, u.category, u.w FROM (SELECT DISTINCT run FROM c), (VALUES ('structural', 0.2), ('functional', 0.3), ('statistical', 0.2), ('execution', 0.15), ('semantic', 0.15)) u(category, w))"


@q(
    "c7_scorecard",
    f"{_FULL} SELECT f.run, f.category, coalesce(score, 100.0) AS score, coalesce(passed, 0) AS passed, coalesce(total, 0) AS total FROM f LEFT JOIN c ON f.run = c.run AND f.category = c.category"
)
def _(t):
    return C.scorecard(_scenarios(t), "run")


@q(
    "c8_overall",
    f"{_FULL}, o AS (SELECT f.run, sum(coalesce(score, 100.0) * w) AS s FROM f LEFT JOIN c ON f.run = c.run AND f.category = c.category GROUP BY 1) SELECT CASE WHEN s >= 89.95 THEN 'High' WHEN s >= 74.95 THEN 'Medium' ELSE 'Low' END AS label, CAST(count(*) AS BIGINT) AS n FROM o WHERE abs(s - 89.95) > 0.001 AND abs(s - 74.95) > 0.001 GROUP BY 1"
)
def _(t):
    card = C.scorecard(_scenarios(t), "run")
    edge = card.groupBy("run").agg(F.sum(F.col("score") * F.element_at(F.create_map(*[F.lit(x) for kv in C.WEIGHTS.items() for x in kv]), F.col("category"))).alias("s"))
    clear = edge.where("abs(s - 89.95) > 0.001 and abs(s - 74.95) > 0.001")  # sums at a rounding edge differ between engines
    return C.overall(card, "run").join(clear, "run").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@q(
    "c9_group_status",
    f"SELECT run, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'completed' END AS status FROM ({_SC}) GROUP BY 1"
)
def _(t):
    return C.group_status(_scenarios(t), "run")


@q(
    "c10_filter_scenarios",
    "SELECT l_linestatus AS section, CAST(count(*) AS BIGINT) AS count FROM lineitem WHERE l_returnflag = 'R' AND contains('line ' || l_linenumber, 'ne 3') GROUP BY 1"
)
def _(t):
    return C.filter_scenarios(_scenarios(t), status="failed", text="NE 3")


@q(
    "c11_approval",
    "WITH s AS (SELECT l_orderkey AS run, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS warnings FROM lineitem GROUP BY 1) SELECT *, CASE WHEN errors = 0 AND warnings = 0 THEN 'approved' WHEN errors = 0 AND warnings <= 2 THEN 'approved_with_warnings' WHEN errors <= 1 THEN 'needs_review' ELSE 'requires_revision' END AS approval FROM s"
)
def _(t):
    sev = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    return C.approval(t.lineitem.select(F.col("l_orderkey").alias("run"), sev.alias("severity")), "run")


_REF = "(SELECT o_custkey, min(CAST(o_orderdate AS DATE)) + 30 AS ref FROM orders GROUP BY 1)"


@q(
    "d1_study_day",
    f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - ref + CASE WHEN CAST(o_orderdate AS DATE) >= ref THEN 1 ELSE 0 END AS INTEGER) AS day, CAST(CAST(o_orderdate AS DATE) - ref + 1 AS INTEGER) AS length FROM orders JOIN {_REF} USING (o_custkey)"
)
def _(t):
    ref = t.orders.groupBy("o_custkey").agg(F.date_add(F.min(F.to_date("o_orderdate")), 30).alias("ref"))
    d = F.to_date("o_orderdate")
    return t.orders.join(ref, "o_custkey").select("o_orderkey", D.study_day(d, F.col("ref")).alias("day"), D.duration(F.col("ref"), d).alias("length"))


@q(
    "d3_yes_no",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag, CAST(o_custkey AS VARCHAR) || '-' || o_orderkey AS subject FROM orders"
)
def _(t):
    yn = F.when(F.col("o_orderstatus") == "F", "y").when(F.col("o_orderstatus") != "P", "N")
    return t.orders.select("o_orderkey", D.yes_no(yn).alias("flag"), D.subject_id("o_custkey", F.lit(" "), "o_orderkey").alias("subject"))


@q("d5_incidence", """WITH pop AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0), ev AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM pop GROUP BY 1), h AS (SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT o_custkey) AS BIGINT) AS subjects FROM ev JOIN pop ON o_custkey = c_custkey GROUP BY 1)
SELECT c_mktsegment, n, events, subjects, round(100.0 * subjects / n, 1) AS percent, subjects || ' (' || printf('%.1f', round(100.0 * subjects / n, 1)) || '%)' AS text, '(N=' || n || ')' AS heading FROM n JOIN h USING (c_mktsegment)""")
def _(t):
    pop = D.population(t.customer.withColumn("SAFFL", F.when(F.col("c_acctbal") > 0, "Y").otherwise("N")), "SAFFL")
    events = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return D.incidence(pop.select("c_custkey", "c_mktsegment"), events, "c_mktsegment", "c_custkey")


# A program for each document, made of its columns.
_TEXT = """'data work.d' || (doc_id % 50) || ';' || chr(10) || ' set raw.' || source || ';' || chr(10) || ' if n > ' || (n_chars % 97) || ' then y = 1; else y = 0; ' || chr(10) || 'run;' || chr(10) || CASE doc_id % 5
WHEN 0 THEN 'proc means data=work.d' || (doc_id % 50) || '; class ' || lang || '; by usubjid; run; RUN' || chr(10) || '// note '
WHEN 1 THEN 'proc sql; create table t' || (doc_id % 7) || ' as select a, case when b then 1 end from work.d' || (doc_id % 50) || ' join lookup on k; quit;'
WHEN 2 THEN '%macro m(x, lib); data out.&lib; merge d1 d2; by k; array z z1-z3; do i = 1 to 3; z = &x + &y; end; run; %mend; %m(1)'
WHEN 3 THEN 'proc sort data=raw.' || source || ' out=s; by k; run; proc report data=s; run; ods pdf; proc logistic data=adae; run;'
ELSE 'proc mixed data=adsl; class trt; lsmeans trt; run; data adsl; set adsl; retain tot; aval = mean(a, b) + sum(a, abs(b)); run;' END"""
_S = f"SELECT doc_id AS id, {_TEXT} AS text FROM documents"


def _scripts(t):
    sql = _TEXT.replace("chr(10)", "char(10)")
    return t.documents.selectExpr("doc_id AS id", f"{sql} AS text")


def _n(p, u="upper(text)"):
    return f"len(regexp_extract_all({u}, '{p}'))"


@q(
    "k1_construct_counts",
    f"WITH s AS ({_S}) SELECT id, CAST({_n('DATA')} AS INTEGER) AS data, CAST({_n('PROC +[A-Z]+')} AS INTEGER) AS procs, CAST({_n('%MACRO')} AS INTEGER) AS macros FROM s"
)
def _(t):
    return K.construct_counts(_scripts(t), {"data": "data", "procs": "proc +[a-z]+", "macros": "%macro"})


def _weights(table, default):
    found = "list_distinct(regexp_extract_all(upper(text), '\\bPROC\\s+(\\w+)', 1))"
    cases = " ".join(f"WHEN '{k.upper()}' THEN {v}" for k, v in table.items())
    return f"coalesce(list_sum([CASE p {cases} ELSE {default} END for p in {found}]), 0)"


_U = lambda p: f"len(list_distinct(regexp_extract_all(upper(text), '{p}')))"
_H = lambda p: f"regexp_matches(upper(text), '{p}')::INT"
_K2 = " + ".join([
    f"2 * {_n(chr(92) + 'bDATA' + chr(92) + 's+' + chr(92) + 'w+')}", f"CASE WHEN {_n(chr(92) + 'bDATA' + chr(92) + 's+' + chr(92) + 'w+')} > 10 THEN 5 ELSE 0 END", _weights(T.PROC_POINTS, 5), f"8 * {_n(r'%MACRO\b')}", f"2 * {_n(r'%[A-Z_]\w*\s*\(')}",
    r"least(10, len(list_distinct(regexp_extract_all(text, '&[A-Za-z_]\w*'))))", f"5 * {_H(r'(?s)%MACRO.*%MACRO\b')}", f"5 * {_U(r'\bSDTM\.|USUBJID|VISITNUM|PARAMCD|DOMAIN')}", f"5 * {_U(r'\bADAM\.|AVAL|BASE|CHG|ANL01FL')}",
    f"11 * {_H(r'\bPROC\s+REPORT\b')}", f"least(10, 2 * {_n(r'\b(?:TRT|TRTPN|ARM|ARMN)\b')})", f"5 * {_H(r'\bODS\s+PDF\b')}", _n(r"\b(?:SET|MERGE|UPDATE|FROM|JOIN)\s+\w+"), _n(r"\bDATA\s+[\w.]+"), f"2 * greatest(0, {_n(r'\bDATA\s+[\w.]+')} - 1)",
    _n(r"\bIF\b"), f"2 * {_n(r'\bDO\b')}", f"5 * {_n(r'\bARRAY\b')}", f"2 * {_n(r'\bRETAIN\b')}", f"3 * {_n(r'\bMERGE\b')}",
])


@q(
    "k2_complexity",
    f"WITH s AS ({_S}), c AS (SELECT id, CAST(least(100, {_K2}) AS INTEGER) AS score FROM s) SELECT id, score, CASE WHEN score <= 20 THEN 1 WHEN score <= 40 THEN 2 WHEN score <= 60 THEN 3 WHEN score <= 80 THEN 4 ELSE 5 END AS level, CASE WHEN score <= 20 THEN 'Basic' WHEN score <= 40 THEN 'Simple' WHEN score <= 60 THEN 'Intermediate' WHEN score <= 80 THEN 'Advanced Clinical' ELSE 'Enterprise' END AS level_name FROM c"
)
def _(t):
    return K.complexity(_scripts(t))


def _any(*words):
    return "(" + " OR ".join(f"contains(u, '{w}')" for w in words) + ")"


def _pt(cond, points):
    return f"CASE WHEN {cond} THEN {points} ELSE 0 END"


def _hit(p):
    return f"regexp_matches(u, '{p}')"


def _c(p):
    return f"len(regexp_extract_all(u, '{p}'))"


def _uq(p):
    return f"len(list_distinct(regexp_extract_all(u, '{p}')))"


def _proc(*names):
    return "(" + " OR ".join(f"list_contains(procs, '{n.upper()}')" for n in names) + ")"


_IN, _OUTP, _STEP, _MAC = _c(r"\b(?:SET|MERGE|FROM|JOIN)\s+[\w.]+"), _c(r"\bDATA\s+[\w.]+"), _c(r"\bDATA\s+\w+"), _c(r"%MACRO\b")
_SEVEN = {
    "constructs": (
        25,
        [
            f"2 * {_STEP}", _pt(f"{_STEP} > 10", 5), _pt(_any("RETAIN"), 1), _pt(_any("ARRAY"), 3), _pt(_any("DO"), 2), _pt(_hit(r"(?s)\bDO\b.*\bDO\b"), 4),
            _pt(_any("IF") + " AND " + _any("ELSE"), 1), _pt(_hit(r"(?s)\bIF\b.*\bIF\b"), 2), _pt(_any("MERGE"), 3), _pt(_any("UPDATE"), 3),
            _pt(_any("MODIFY"), 4), _pt(_any("DECLARE") + " AND " + _any("HASH"), 5),
            f"least(20, {_weights(T.PROC_POINTS_SEVEN, 2).replace('upper(text)', 'u')})"
        ]
    ),
    "clinical": (
        20,
        [
            _pt(_any("SDTM", "USUBJID", "VISITNUM", "PARAMCD", "DOMAIN"), 4), _pt(_any("ADAM", "AVAL", "BASE", "CHG", "ANL01FL", "ADSL"), 4),
            _pt(_any("PROC REPORT", "PROC TABULATE"), 4), _pt(_any("PROC REPORT"), 2), _pt(_any("PROC COMPARE"), 2), _pt(_any("QC.", "QC_", "COMPARE"), 2),
            _pt(_any("STUDYID", "USUBJID"), 2)
        ]
    ),
    "execution": (
        20,
        [
            _pt(f"{_IN} > 5", 2), _pt(f"{_OUTP} > 6", 4), _pt(f"{_OUTP} > 3", 2), _pt(_c(r"\bJOIN\b") + " > 1", 3), _pt(_hit(r"\(\s*SELECT\b"), 2),
            _pt(_any("CASE") + " AND " + _any("WHEN"), 2), _pt(_c(r"\bIF\b") + " > 3", 3), _pt(f"{_IN} + {_OUTP} > 5", 2)
        ]
    ),
    "data": (
        15,
        [
            f"least(5, {_IN})", _pt(_hit(r"\bBY\b"), 2), _pt(_uq(r"\b\w+\.\w+\b") + " > 1", 2), _pt(_any("LOOKUP", "REF", "MAP", "CODE"), 2),
            _pt(_any("FORMAT ", "PROC FORMAT"), 2), _pt(_any("INFORMAT"), 2)
        ]
    ),
    "macro": (
        10,
        [
            _pt(f"{_MAC} > 0", 3), f"least(3, {_c('%' + chr(92) + 'w+')} - {_MAC})", _pt(_hit(r"(?s)%MACRO.*%MACRO\b"), 3), _pt(f"{_MAC} > 2", 5),
            _pt(_any("CALL EXECUTE"), 5), f"least(3, {_uq('&' + chr(92) + 'w+')})"
        ]
    ),
    "statistical": (
        5,
        [
            _pt(_proc("means", "summary", "freq", "univariate"), 1), _pt(_proc("reg", "glm", "logistic", "genmod"), 2), _pt(_proc("lifetest", "phreg"), 3),
            _pt(_proc("mixed", "glimmix"), 3), _pt(_any("BAYES", "MCMC"), 4)
        ]
    ),
    "reporting": (5, [_pt(_proc("report"), 2), _pt(_proc("template"), 2), _pt(_any("ODS"), 1), _pt(_any("PDF", "RTF", "EXCEL", "XLSX"), 1)]),
    "bonus": (5, [_pt(_any("CALL EXECUTE"), 2), _pt(_any("CALL SYMPUT"), 2), _pt(_any("DICTIONARY.COLUMNS", "DICTIONARY.TABLES"), 1), _pt(_any("PROC FORMAT"), 2)]),
}
_K4 = f"""WITH s AS ({_S}), v AS (SELECT id, upper(text) AS u, list_distinct(regexp_extract_all(upper(text), '\\bPROC\\s+(\\w+)', 1)) AS procs FROM s),
d AS (SELECT id, {', '.join(f"CAST(least({cap}, {' + '.join(parts)}) AS INTEGER) AS {k}" for k, (cap, parts) in _SEVEN.items())}, {_pt(f'{_STEP} = 1', 3)} + {_pt('len(procs) = 0', 5)} + {_pt("NOT contains(u, '%')", 2)} + {_pt(f'{_IN} = 1', 2)} AS p FROM v),
e AS (SELECT * EXCLUDE (p), p + CASE WHEN clinical = 0 THEN 3 ELSE 0 END AS penalty FROM d) SELECT *, greatest(0, least(100, {' + '.join(_SEVEN)} - penalty)) AS total FROM e"""


@q("k4_seven_dimensions", _K4)
def _(t):
    return K.seven_dimensions(_scripts(t))


_K5 = " + ".join([f"{w} * {_H(p)}" for p, w in T.FEATURES] + [f"{w} * ({_H(a)} * {_H(b)})" for (a, b), w in T.PAIRED])


@q(
    "k5_tiers",
    f"WITH s AS ({_S}), c AS (SELECT id, CAST({_K5} AS INTEGER) AS score FROM s) SELECT id, score, CASE WHEN score >= 30 THEN 5 WHEN score >= 18 THEN 4 WHEN score >= 9 THEN 3 WHEN score >= 4 THEN 2 ELSE 1 END AS tier FROM c"
)
def _(t):
    return K.tiers(_scripts(t))


_E = f"""s AS ({_S}), e AS (SELECT DISTINCT id, lower(u.d) AS dataset, u.kind FROM (
SELECT id, unnest(regexp_extract_all(upper(text), '{T.INPUTS}', 1)) AS d, 'required' AS kind FROM s UNION ALL SELECT id, unnest(regexp_extract_all(upper(text), '{T.CREATED}', 1)), 'created' FROM s) u WHERE NOT starts_with(u.d, '_')),
x AS (SELECT id, dataset FROM e WHERE kind = 'required' AND (id, dataset) NOT IN (SELECT (id, dataset) FROM e WHERE kind = 'created')),
roles AS (SELECT id, dataset, CASE WHEN bool_or(kind = 'required') AND bool_or(kind = 'created') THEN 'intermediate' WHEN bool_or(kind = 'required') THEN 'source' ELSE 'output' END AS role FROM e GROUP BY 1, 2)"""


def _edges(t):
    return K.edges(_scripts(t))


@q("k6_edges", f"WITH {_E} SELECT * FROM e")
def _(t):
    return _edges(t)


@q("k7_external_inputs", f"WITH {_E} SELECT * FROM x")
def _(t):
    return K.external_inputs(_edges(t))


@q("k7_self_contained", f"WITH {_E} SELECT id, id NOT IN (SELECT id FROM x) AS self_contained FROM (SELECT DISTINCT id FROM e)")
def _(t):
    return K.self_contained(_edges(t))


@q("k8_lineage_roles", f"WITH {_E} SELECT * FROM roles")
def _(t):
    return K.lineage_roles(_edges(t))


@q("k9_upload_decisions", f"WITH {_E} SELECT id, dataset, role = 'source' AS upload FROM roles")
def _(t):
    return K.upload_decisions(_edges(t)).select("id", "dataset", "upload")


_STEPS = f"""s AS ({_S}), b AS (SELECT id, unnest(regexp_extract_all(upper(text), '(?s)\\bDATA\\s+[A-Z_][\\w.]*\\s*;.*?\\bRUN\\s*;')) AS step FROM s),
st AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(step, '\\b(?:SET|MERGE|UPDATE|MODIFY)\\s+([A-Z_][\\w.]*)', 1))) AS src, lower(regexp_extract(step, '\\bDATA\\s+([A-Z_][\\w.]*)', 1)) AS dst FROM b)"""


@q(
    "k10_dependency_depth",
    f"WITH RECURSIVE {_STEPS}, n AS (SELECT id, src AS dataset FROM st UNION SELECT id, dst FROM st), r AS (SELECT id, dataset, 0 AS depth FROM n UNION SELECT r.id, st.dst, r.depth + 1 FROM r JOIN st ON r.id = st.id AND r.dataset = st.src AND st.src <> st.dst) SELECT id, dataset, CAST(max(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2"
)
def _(t):
    return K.dependency_depth(K.step_edges(_scripts(t)))


@q("k10_self_cycles", f"WITH s AS ({_S}) SELECT id, 'adsl' AS dataset FROM s WHERE contains(text, 'data adsl; set adsl;')")
def _(t):
    return K.self_cycles(K.step_edges(_scripts(t)))


_UP = "SELECT DISTINCT 'raw.' || source || CASE WHEN hash_of % 3 = 0 THEN '' ELSE '_old' END AS dataset FROM (SELECT source, CAST(ascii(right(source, 1)) AS BIGINT) AS hash_of FROM documents)"


def uploads(t):
    """A dataset for each source; two in three have another name than the programs ask for."""
    return t.documents.select(F.concat(F.lit("raw."), "source", F.when(F.ascii(F.right("source", F.lit(1))) % 3 == 0, "").otherwise("_old")).alias("dataset"))


@q(
    "k11_readiness",
    f"WITH {_E}, u AS ({_UP}), n AS (SELECT id, CAST(count(*) AS BIGINT) AS required, CAST(count(*) FILTER (WHERE dataset NOT IN (SELECT dataset FROM u)) AS BIGINT) AS missing FROM x GROUP BY 1), d AS (SELECT i.id, coalesce(required, 0) AS required, coalesce(missing, 0) AS missing, CASE WHEN required IS NULL THEN 100.0 ELSE 100.0 * (required - missing) / required END AS data FROM (SELECT DISTINCT id FROM e) i LEFT JOIN n ON i.id = n.id) SELECT id, required, missing, round(data, 6) AS data, CASE WHEN data = 100 THEN true ELSE 0.5 * data + 44 >= 80 END AS ready, CASE WHEN data > 90 THEN 'Excellent' WHEN data > 75 THEN 'Good' WHEN data > 50 THEN 'Fair' ELSE 'Poor' END AS health, CASE WHEN missing > required * 0.3 THEN 'HIGH' WHEN missing > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d"
)
def _(t):
    uploaded = uploads(t)
    return K.readiness(_edges(t), uploaded).select("id", "required", "missing", F.round("data", 6).alias("data"), "ready", "health", "risk")


@q(
    "k13_impact_scores",
    f"WITH s AS ({_S}) SELECT id, CASE WHEN contains(upper(text), '%MACRO') THEN 80 ELSE 90 END AS parser, CAST(greatest(0, 80 - 10 * {_n('PROC +(?:LOGISTIC|GENMOD|MIXED|GLIMMIX)')}) AS INTEGER) AS packages FROM s"
)
def _(t):
    return K.impact_scores(_scripts(t))


@q(
    "k14_upload_priority",
    f"WITH {_E} SELECT id, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN starts_with(dataset, 'raw.') THEN 1 ELSE 3 END, dataset) AS step, dataset, CASE WHEN starts_with(dataset, 'raw.') THEN 'CRITICAL' ELSE 'OPTIONAL' END AS priority FROM x"
)
def _(t):
    return K.upload_priority(K.external_inputs(_edges(t)).withColumn("upload", F.when(F.startswith("dataset", F.lit("raw.")), "true").otherwise("false")))


def _hits(words):
    return f"len(list_distinct(regexp_extract_all(t, '\\b(?:{'|'.join(words)})\\b')))"


@q(
    "k15_domain",
    "WITH d AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS t FROM documents), h AS (SELECT id, " + ", ".join(f"{_hits(w)} AS {d}" for d, w in T.DOMAINS.items()) + f", regexp_matches(left(t, 200), '\\b(?:{'|'.join(T.DEMO)})\\b') AS demo FROM d), b AS (SELECT *, greatest({', '.join(T.DOMAINS)}) AS n FROM h) SELECT id, CASE WHEN (demo AND clinical < 3) OR n < 2 THEN 'general' " + " ".join(f"WHEN {d} = n THEN '{d}'" for d in T.DOMAINS) + " END AS domain, CASE WHEN demo AND clinical < 3 THEN 0.6 WHEN n = 0 THEN 0.5 WHEN n < 2 THEN 0.4 ELSE least(n / 5, 1.0) END AS confidence FROM b"
)
def _(t):
    return K.domain(t.documents.select(F.col("doc_id").alias("id"), F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("text")))


@q(
    "k16_goals",
    f"WITH s AS ({_S}), g AS (SELECT id, list_filter_null AS v FROM (SELECT id, [x for x in [" + ", ".join(
        f"CASE WHEN regexp_matches(text, '(?is){'|'.join(p)}') THEN '{g}' END" for g, p in T.GOALS.items()
    ) + "] if x IS NOT NULL] AS list_filter_null FROM s)) SELECT id, coalesce(v[1], 'data_analysis') AS \"primary\", coalesce(nullif(array_to_string(v, ','), ''), 'data_analysis') AS goals FROM g"
)
def _(t):
    return K.goals(_scripts(t))


@q(
    "k17_complexity_class",
    f"WITH s AS ({_S}), c AS (SELECT {_n('DATA')} + 2 * {_n('PROC')} + 3 * {_n('%MACRO')} AS score FROM s) SELECT CASE WHEN score <= 5 THEN 'simple' WHEN score <= 12 THEN 'moderate' WHEN score <= 20 THEN 'complex' ELSE 'highly_complex' END AS class, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1"
)
def _(t):
    c = K.construct_counts(_scripts(t), {"d": "data", "p": "proc", "m": "%macro"})
    return c.groupBy(K.complexity_class(F.col("d") + 2 * F.col("p") + 3 * F.col("m")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@q("k18_macro_variables", f"WITH s AS ({_S}) SELECT id, CASE WHEN id % 5 = 2 THEN 'lib,x,y' ELSE '' END AS used, CASE WHEN id % 5 = 2 THEN 'y' ELSE '' END AS unresolved FROM s")
def _(t):
    return K.macro_variables(_scripts(t))


@q(
    "k19_inventory",
    f"WITH s AS ({_S}), c AS (SELECT id, unnest(regexp_extract_all(lower(text), '\\b([a-z_]\\w*)\\(', 1)) AS name FROM s), m AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'sum' ELSE 'abs' END AS name, CASE WHEN o_orderstatus = 'F' THEN 'sum_of' ELSE 'abs_' END AS equivalent FROM orders) SELECT id, c.name, CAST(count(*) AS BIGINT) AS uses, any_value(equivalent) AS equivalent FROM c LEFT JOIN m USING (name) GROUP BY 1, 2"
)
def _(t):
    f = F.col("o_orderstatus") == "F"
    table = t.orders.select(F.when(f, "sum").otherwise("abs").alias("name"), F.when(f, "sum_of").otherwise("abs_").alias("equivalent")).distinct()
    return K.inventory(_scripts(t), table)


_LINES = f"s AS ({_S}), l AS (SELECT id, unnest(range(1, len(v) + 1)) AS line, unnest(v) AS t FROM (SELECT id, string_split(text, chr(10)) AS v FROM s))"


@q(
    "k20_lint",
    f"WITH {_LINES} SELECT id, CAST(line AS INTEGER) AS line, 'semicolon' AS issue FROM l WHERE upper(trim(t)) IN ('RUN', 'QUIT', 'DATA', 'PROC SORT') UNION ALL SELECT id, line, 'comment' FROM l WHERE starts_with(trim(t), '//') UNION ALL SELECT id, line, 'trailing_blanks' FROM l WHERE regexp_matches(t, '[ \\t]+$')"
)
def _(t):
    return K.lint(_scripts(t))


@q("k20_balance", f"WITH s AS ({_S}) SELECT id, CAST({_n(r'\bDO\b')} - {_n(r'\bEND\b')} AS INTEGER) AS do_end, CAST({_n(r'\(')} - {_n(r'\)')} AS INTEGER) AS parentheses FROM s")
def _(t):
    return K.balance(_scripts(t))


@q("k21_line_counts", "SELECT doc_id AS id, len([x for x in string_split(text, chr(10)) if trim(x) <> '']) AS lines FROM documents")
def _(t):
    return K.line_counts(t.documents.select(F.col("doc_id").alias("id"), "text"))


@q(
    "k22_match_names",
    f"WITH {_E}, f AS (SELECT DISTINCT CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN source ELSE 'old_' || source END AS b FROM documents) SELECT id, CAST(count(f.b) AS BIGINT) AS satisfied, CAST(count(*) AS BIGINT) AS total FROM x LEFT JOIN f ON f.b = regexp_replace(x.dataset, '^.*\\.', '') GROUP BY 1"
)
def _(t):
    files = t.documents.select(F.concat(F.when(F.ascii(F.right("source", F.lit(1))) % 2 == 0, "").otherwise("old_"), "source", F.lit(".CSV")).alias("file"))
    return K.match_names(K.external_inputs(_edges(t)), files)
