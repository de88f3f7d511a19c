"""Patterns, words and points by which programs are scored and tagged. They must be as they are for right results.

A rule is (kind, what, points) or (kind, what, points, limit); ``programs.rule_points`` says what each kind counts.
Patterns are matched against upper-case text, words are looked for anywhere in it.
"""

from __future__ import annotations

# Points of procedures by name, in two scorings.
PROC_POINTS = {
    "print": 2, "contents": 2, "sort": 3, "freq": 3, "format": 3, "import": 4, "export": 4, "means": 5, "summary": 5, "transpose": 5, "sql": 8, "report": 8, "compare": 8, "tabulate": 8,
    "univariate": 8, "lifetest": 12, "phreg": 12, "mixed": 12, "glimmix": 12, "logistic": 10, "genmod": 10,
}
PROC_POINTS_SEVEN = {
    "print": 1, "contents": 1, "sort": 2, "freq": 2, "format": 2, "import": 2, "export": 2, "sql": 5, "means": 4, "summary": 4, "report": 5, "tabulate": 5, "transpose": 4, "compare": 5,
    "lifetest": 7, "phreg": 8, "mixed": 8, "glimmix": 8, "logistic": 7, "genmod": 7,
}

# Features, each a pattern with the points of its first hit, and pairs of patterns that both must hit.
FEATURES = [
    (r"\bDATA\s+\w+", 1), (r"\bSET\s+\w+", 1), (r"\bPROC\s+MEANS\b", 1), (r"\bPROC\s+FREQ\b", 1), (r"\bPROC\s+SORT\b", 1), (r"\bPROC\s+PRINT\b", 1), (r"\bIF\s+.+THEN\b", 1), (r"\bKEEP\b", 1),
    (r"\bDROP\b", 1), (r"\bPROC\s+SQL\b", 4), (r"\bMERGE\s+\w+", 3), (r"\bFORMAT\b", 1), (r"\bLABEL\b", 1), (r"\bLENGTH\b", 1), (r"\bOUTPUT\b", 1), (r"\bRENAME\b", 1), (r"\bIN=\w+", 2),
    (r"%MACRO\b", 6), (r"&[A-Z_]\w*", 3), (r"\bARRAY\b", 4), (r"\bRETAIN\b", 3), (r"\bPROC\s+TRANSPOSE\b", 3), (r"\b(FIRST|LAST)\.\w+", 3), (r"\bDO\s+[A-Z_]\w*\s*=", 2), (r"\bPROC\s+REG\b", 3),
    (r"\bPROC\s+UNIVARIATE\b", 3), (r"\b(USUBJID|SUBJID|VISIT\b|VISITNUM|AVISITN|PARAMCD|DOMAIN)", 6), (r"\b(AVAL|BASE|CHG|DTYPE|ANL01FL|BASEFL)\b", 6),
    (r"\b(SAFFL|ITTFL|PPROTFL|COMPLFL|RANDFL|ENRLFL)\b", 5), (r"\b(ADSL|ADAE|ADLB|ADTTE|ADRS|ADVS)\b", 7), (r"\bODS\s+(OUTPUT|HTML|PDF)\b", 3), (r"\bPROC\s+REPORT\b", 4),
    (r"\bPROC\s+TABULATE\b", 4), (r"\b(CDISC|SDTM|ADAM)\b", 5), (r"\b(YRDIF|INTCK|INTNX)\b", 3), (r"\b(IS8601DT|DATE9)\b", 2), (r"\bPROC\s+MIXED\b", 12), (r"\bPROC\s+PHREG\b", 12),
    (r"\bPROC\s+LIFETEST\b", 10), (r"\bPROC\s+LOGISTIC\b", 9), (r"\bPROC\s+GENMOD\b", 9), (r"\bLSMEANS\b", 5), (r"\bHAZARDRATIO\b", 5), (r"\bDDFM\s*=\s*KR\b", 5), (r"\bBASELINE\s+OUT\s*=", 4),
    (r"\bPROC\s+STDRATE\b", 6),
]
PAIRED = [((r"\bINPUT\b", r"\b(DATALINES|CARDS)\b"), 1), ((r"\bSELECT\s*\(", r"\bWHEN\s*\("), 2), ((r"\bREPEATED\b", r"\bSUBJECT\s*="), 6), ((r"\bESTIMATE\b", r"\bCL\b"), 4)]

# Least scores of the tiers.
TIERS = [(30, 5), (18, 4), (9, 3), (4, 2)]

# Key words of subject areas.
DOMAINS = {
    "clinical": [
        "patient", "heartrate", "temperature", "blood", "pressure", "dose", "treatment", "subject", "visit", "adverse", "event", "protocol", "sdtm", "adam",
        "usubjid", "subjid", "fever", "diagnosis", "symptom", "clinical", "hospital", "drug", "placebo", "endpoint", "baseline", "efficacy", "safety",
        "randomize", "cohort", "pharmacokinetics", "pharmacodynamics",
    ],
    "financial": [
        "revenue", "profit", "sales", "cost", "expense", "income", "budget", "forecast", "quarterly", "annual", "margin", "roi", "investment", "portfolio",
        "price", "stock", "equity", "asset", "liability", "balance", "ledger", "transaction", "fiscal",
    ],
    "retail": [
        "product", "category", "store", "region", "sales", "customer", "order", "quantity", "inventory", "sku", "promotion", "discount", "shelf", "brand",
        "supplier", "shipment",
    ],
    "hr": [
        "employee", "salary", "department", "hire", "position", "grade", "performance", "headcount", "turnover", "manager", "payroll", "benefits", "leave",
        "attendance", "appraisal",
    ],
    "survey": [
        "response", "question", "rating", "score", "survey", "likert", "respondent", "agree", "disagree", "strongly", "neutral", "questionnaire", "interview",
    ],
    "manufacturing": [
        "batch", "yield", "defect", "quality", "process", "machine", "unit", "production", "inspection", "tolerance", "spec",
    ],
}

# Words of demonstrations.
DEMO = ["demo", "test", "example", "sample", "function"]

# What programs are for, each a list of patterns of which one must hit, in either case.
GOALS = {
    "dataset_creation": [r"\bdata\s+\w+\s*;.*?\binput\b", r"\bdata\s+\w+\s*;.*?\bdatalines\b", r"\bdata\s+\w+\s*;.*?\bcards\b"],
    "data_transformation": [r"\bdata\s+\w+\s*;.*?\bset\b", r"\bdata\s+\w+\s*;.*?\bmerge\b", r"\bif\b.+?\bthen\b", r"\bretain\b", r"\barray\b"],
    "statistical_analysis": [r"\bproc\s+means\b", r"\bproc\s+freq\b", r"\bproc\s+corr\b", r"\bproc\s+univariate\b"],
    "regression_modeling": [r"\bproc\s+reg\b", r"\bproc\s+glm\b", r"\bproc\s+logistic\b", r"\bproc\s+mixed\b"],
    "survival_analysis": [r"\bproc\s+phreg\b", r"\bproc\s+lifetest\b"],
    "data_reporting": [r"\bproc\s+print\b", r"\bproc\s+report\b", r"\bproc\s+tabulate\b"],
    "data_export": [r"\bproc\s+export\b"],
    "database_operations": [r"\bproc\s+sql\b"],
    "classification": [r"\bif\b.+?>\s*\d+.+?\bthen\b", r"\bif\b.+?<\s*\d+.+?\bthen\b", r"\bcase_when\b"],
    "data_sorting": [r"\bproc\s+sort\b"],
    "data_reshaping": [r"\bproc\s+transpose\b"],
}

# Names of datasets that a program reads and makes.
INPUTS = r"\b(?:SET|MERGE|UPDATE|MODIFY|FROM|JOIN|DATA=)\s*([A-Z_][\w.]*)"
CREATED = r"(?:\bDATA\s+|\bOUT=\s*|\bCREATE\s+TABLE\s+)([A-Z_][\w.]*)"

_STEP, _MADE, _READ, _MACRO = r"\bDATA\s+\w+", r"\bDATA\s+[\w.]+", r"\b(?:SET|MERGE|FROM|JOIN)\s+[\w.]+", r"%MACRO\b"

# Constructs of the first scoring, whose sum is held to 100.
COMPLEXITY = [
    ("each", _STEP, 2), ("over", [_STEP], 5, 10), ("procedures", PROC_POINTS, 5), ("each", r"%MACRO\b", 8), ("each", r"%[A-Z_]\w*\s*\(", 2), ("distinct as written", r"&[A-Za-z_]\w*", 1, 10),
    ("hit", r"(?s)%MACRO.*%MACRO\b", 5), ("each", r"\bCALL\s+EXECUTE\b", 10), ("distinct", r"\bSDTM\.|USUBJID|VISITNUM|PARAMCD|DOMAIN", 5), ("distinct", r"\bADAM\.|AVAL|BASE|CHG|ANL01FL", 5),
    ("hit", r"\bPROC\s+(REPORT|TABULATE)\b", 6), ("hit", r"\bPROC\s+REPORT\b", 5), ("hit", r"\bPROC\s+COMPARE\b", 5), ("each", r"\b(?:TRT|TRTPN|ARM|ARMN)\b", 2, 10),
    ("each", r"\b(?:SAFFL|ITTFL|PPROTFL|COMPLFL|RANDFL)\b", 2, 10), ("hit", r"\bODS\s+(OUTPUT|HTML|PDF|RTF)\b", 3), ("each", r"\b(?:SET|MERGE|UPDATE|FROM|JOIN)\s+\w+", 1), ("each", _MADE, 1),
    ("beyond the first", _MADE, 2), ("each", r"\bIF\b", 1), ("each", r"\bIF\b.*\bIF\b", 2), ("each", r"\bDO\b", 2), ("each", r"\bDO\b.*\bDO\b", 4), ("each", r"\bARRAY\b", 5), ("each", r"\bRETAIN\b", 2),
    ("each", r"\bMERGE\b", 3), ("each", r"\bUPDATE\b", 3), ("each", r"\bMODIFY\b", 4), ("hit", r"\bPROC\s+TEMPLATE\b", 5), ("hit", r"\bODS\s+PDF\b", 2), ("hit", r"\b(EXCEL|EXCELXP)\b", 2),
    ("hit", r"\bODS\s+RTF\b", 2),
]

# The dimensions of the second scoring, each with the most that it gives, and its rules.
SEVEN = {
    "constructs": (25, [
        ("each", _STEP, 2), ("over", [_STEP], 5, 10), ("word", ["RETAIN"], 1), ("word", ["ARRAY"], 3), ("word", ["DO"], 2), ("hit", r"(?s)\bDO\b.*\bDO\b", 4), ("words", ["IF", "ELSE"], 1),
        ("hit", r"(?s)\bIF\b.*\bIF\b", 2), ("word", ["MERGE"], 3), ("word", ["UPDATE"], 3), ("word", ["MODIFY"], 4), ("words", ["DECLARE", "HASH"], 5), ("procedures", PROC_POINTS_SEVEN, 2, 20),
    ]),
    "clinical": (20, [
        ("word", ["SDTM", "USUBJID", "VISITNUM", "PARAMCD", "DOMAIN"], 4), ("word", ["ADAM", "AVAL", "BASE", "CHG", "ANL01FL", "ADSL"], 4), ("word", ["PROC REPORT", "PROC TABULATE"], 4),
        ("word", ["PROC REPORT"], 2), ("word", ["PROC COMPARE"], 2), ("word", ["QC.", "QC_", "COMPARE"], 2), ("word", ["STUDYID", "USUBJID"], 2),
    ]),
    "execution": (20, [
        ("over", [_READ], 2, 5), ("over", [_MADE], 4, 6), ("over", [_MADE], 2, 3), ("over", [r"\bJOIN\b"], 3, 1), ("hit", r"\(\s*SELECT\b", 2), ("words", ["CASE", "WHEN"], 2), ("over", [r"\bIF\b"], 3, 3),
        ("over", [_READ, _MADE], 2, 5),
    ]),
    "data": (15, [
        ("each", _READ, 1, 5), ("hit", r"\bBY\b", 2), ("several", r"\b\w+\.\w+\b", 2), ("word", ["LOOKUP", "REF", "MAP", "CODE"], 2), ("word", ["FORMAT ", "PROC FORMAT"], 2), ("word", ["INFORMAT"], 2),
    ]),
    "macro": (10, [
        ("over", [_MACRO], 3, 0), ("each but definitions", r"%\w+", 1, 3), ("hit", r"(?s)%MACRO.*%MACRO\b", 3), ("over", [_MACRO], 5, 2), ("word", ["CALL EXECUTE"], 5), ("distinct", r"&\w+", 1, 3),
    ]),
    "statistical": (5, [
        ("procedure", ["means", "summary", "freq", "univariate"], 1), ("procedure", ["reg", "glm", "logistic", "genmod"], 2), ("procedure", ["lifetest", "phreg"], 3), ("procedure", ["mixed", "glimmix"], 3),
        ("word", ["BAYES", "MCMC"], 4),
    ]),
    "reporting": (5, [("procedure", ["report"], 2), ("procedure", ["template"], 2), ("word", ["ODS"], 1), ("word", ["PDF", "RTF", "EXCEL", "XLSX"], 1)]),
    "bonus": (5, [("word", ["CALL EXECUTE"], 2), ("word", ["CALL SYMPUT"], 2), ("word", ["DICTIONARY.COLUMNS", "DICTIONARY.TABLES"], 1), ("word", ["PROC FORMAT"], 2)]),
}
# What is taken off, and what a program without clinical points loses besides.
PENALTIES = [("exactly one", _STEP, 3), ("no procedure", None, 5), ("without", ["%"], 2), ("exactly one", _READ, 2)]
NOT_CLINICAL = 3
