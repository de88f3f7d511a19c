"""Personal data by candidate gradient boosting, in DataFrame functions only.

Well-formed e-mail addresses, IP addresses, card numbers and phone numbers are reported as they
are. High-recall generators propose further, overlapping spans: spelled-out addresses, account
numbers, and any run of seven or more digits with separators. Boosted trees score those by format
and context, a calibrated threshold selects, and of overlapping selections
the more specific generator's stays; none may overlap a well-formed span.

The trees are trained on sentences that Spark makes from templates with hashed digits (``EXAMPLES``
for each template), through the same generators and features; the fit sees the table of distinct
feature vectors. The threshold is calibrated on templates that the trees have not seen: each fold of the
templates is scored by trees of the other folds. Matches become rows once: every document writes one row
per match, or one row without a match, with the number of its row, and positions are running sums there.

Spans are code points, end exclusive. Defined results: a null or blank text has no spans; rows are
kept one for one, whatever their id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting
from . import common as C

EXAMPLES = 60
#: Share of the selected spans that is to be right on templates not seen; on these, the trees then find 0.87 of the personal data.
PRECISION = 0.95
#: Few shallow trees: deeper ones are surer of the templates and worse on others.
TREES = {"rounds": 20, "depth": 2, "shrink": 0.3}
# A run's first character is never looked for inside the run, so long runs cost one pass; possessive
# groups (++) need no stack. Neither changes what the contract's patterns match.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{2,64}+\x20?[\(\[]at[\)\]]\x20?[A-Za-z0-9-]{2,63}+\x20?[\(\[]dot[\)\]]\x20?[A-Za-z]{2,12}",
    "account": r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "digits": r"\(?[0-9](?:[\x20./()-]{0,2}[0-9]){6,}+",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(GENERATORS)
CONTEXT = 32
FEATURES = ["kind", "n_digits", "n_separators", "shape", "glued", "cue", "luhn", "capitals"]
# Templates of training sentences: '#' is a digit. The first list holds personal data, the second does not.
PRIVATE = (
    "call me at ###-###-#### today", "tel: (###) ###-####", "phone ### ### ####", "mobile ###.###.####", "fax ###-####-####", "my number is ###-###-####", "ring ###-###-#### after six",
    "whatsapp ### ### ####", "she answers on ###.###.####", "dial (###) ###-#### first", "ssn ###-##-####", "SSN: ### ## ####", "social security number ###-##-####", "social on file ###-##-####",
    "passport no #########", "passport ######### was issued", "driver license number ########", "tax id ##-#######", "patient id #########", "national insurance ########",
    "card number #### #### #### ####", "visa #### #### #### ####", "IBAN DE## #### #### #### #### ##", "iban GB##WEST############", "account FR## #### #### #### #### #### ###",
    "transfer to NL##ABNA##########", "bank account ##########", "sort code and account ##########", "write to jane.doe (at) example (dot) com", "mail bob## [at] mail [dot] org",
    "her address: anna## [at] host [dot] net", "contact eve.x [at] mail [dot] org", "reach carl# (at) post (dot) com", "mail fred_ott (at) web (dot) de", "write gil## [at] net [dot] fr",
    "born ##/##/####", "date of birth ####-##-##", "dob ##/##/####",
)
PUBLIC = (
    "order ###-###-#### shipped", "part no ##########", "isbn ###-#-##-######-#", "version #.#.#######", "see page ### ### ####", "on ####-##-## ##:##", "from ##/##/#### to", "released ####-##-##",
    "total ### ### ###", "score ### ### ####", "build ########", "batch ##########", "id ###-##-####-##", "lot ###-##-####", "values ##.### ##.### ##.###", "coordinates ##.#### ###.####",
    "sku DE## #### #### ####", "code AB## #### #### ####", "model GB##ABCD############", "ticket ########", "invoice ###-##-####", "serial ###-###-####", "tracking ## #### #### ####",
    "grid ###.###.####", "ratio ###.###.####", "meeting room## [at] site [dot] map", "stop here [at] dawn [dot] over", "order by gate## (at) yard (dot) one", "see page nine [at] end [dot] two",
    "he sat (at) home (dot) then", "error ########## in", "port ####.####.####", "index ### / ### / ####",
)
#: Parts of the templates that are scored by trees of the other parts.
FOLDS = 5
# Words before a number that speak for personal data (2) or against it (0); not all of the templates' words are among them, nor the other way round.
_CUES = {
    2: "tel|telephone|phone|mobile|call|fax|cell|contact|dial|ring|whatsapp|sms|text me|ssn|social security|passport|licen[sc]e number|tax id|national id|insurance|patient|card number|visa|iban|account|born|birth|dob|my number|write to|mail|reach",
    0: "order|part no|isbn|issn|version|page|chapter|total|sum|build|values|sku|model|ticket|invoice|tracking|grid|error|port|from|on|meeting|serial|batch|lot|release|room|figure|ref|case no",
}
_CUES = {k: rf"(?i)({words})[\p{{L}} .:#]{{0,16}}$" for k, words in _CUES.items()}


def _matches(text: Column) -> Column:
    """All generators' matches of a text, with the length of what precedes each since the last and the text around it."""
    found = []
    for number, pattern in enumerate(GENERATORS.values()):
        both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
        needs = F.contains(text, F.lit("@")) if number == 0 else F.contains(text, F.lit("+")) if number == 3 else F.rlike(text, F.lit(r"[\(\[]at[\)\]]")) if number == 4 else F.rlike(text, F.lit("[0-9]"))
        found.append(F.when(needs, both).alias(KINDS[number]))
    return F.struct(*found)


def candidates(rows: DataFrame) -> DataFrame:
    """One row per match of a generator (or one with a null kind) for rows (row, text and others): kind, start, end, match, before, after."""
    kept = [c for c in rows.columns if c != "text"]
    taken = rows.select(*kept, _matches(F.col("text")).alias("m"))

    def of(number: int) -> Column:
        m = F.col("m")[KINDS[number]]
        listed = F.transform(
            F.arrays_zip(m["hits"].alias("hits"), m["between"].alias("between"), F.slice(m["between"], F.lit(2), F.greatest(F.size(m["between"]) - 1, F.lit(0))).alias("next")),
            lambda x, i: F.struct(
                F.lit(number).alias("kind"), i.alias("at"), F.length(x["between"]).alias("gap"), x["hits"].alias("match"),
                F.right(x["between"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")
            ),
        )
        return F.coalesce(F.filter(listed, lambda x: x["match"].isNotNull()), F.array().cast("array<struct<kind:int,at:int,gap:int,match:string,before:string,after:string>>"))

    spread = C.staged(taken.select(*kept, F.explode_outer(F.concat(*[of(i) for i in range(len(KINDS))])).alias("c")).select(*kept, "c.*"), "matches").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    return spread.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def _digits(c: str) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.ascii(d) - 48)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _well_formed() -> Column:
    """Whether a base generator's match is kept."""
    n = F.length(_digits("match"))
    parts = F.transform(F.split("match", "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    octets = F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    return F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, octets).when(F.col("kind") == 2, n.between(16, 19) & _luhn(_digits("match"))).when(F.col("kind") == 3, n.between(8, 15)).otherwise(False)


def with_features(found: DataFrame) -> DataFrame:
    """Coarse integer features of format and context; null on base kinds, where they are not needed."""
    digits = _digits("match")
    shape = (
        F.when(F.rlike("match", F.lit(r"^\(?[0-9]{3}\)?[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}$")), 1)
        .when(F.rlike("match", F.lit(r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$")), 2)
        .when(F.rlike("match", F.lit(r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})")), 3)
        .when(F.rlike("match", F.lit(r"^[0-9]+$")), 4)
        .when(F.rlike("match", F.lit(r"^[0-9]{4}( [0-9]{4}){3}$")), 5)
        .otherwise(0)
    )
    cue = F.when(F.rlike("before", F.lit(_CUES[2])), 2).when(F.rlike("before", F.lit(_CUES[0])), 0).otherwise(1)
    values = {
        "n_digits": F.least(F.length(digits), F.lit(20)), "n_separators": F.least(F.length("match") - F.length(digits), F.lit(8)), "shape": shape,
        "glued": F.rlike("before", F.lit(r"[\p{L}\p{N}_@/.-]$")).cast("int") + F.rlike("after", F.lit(r"[\p{L}\p{N}_@/]")).cast("int"), "cue": cue,
        "luhn": _luhn(digits).cast("int"), "capitals": F.least(F.length(F.regexp_replace("match", "[^A-Z]", "")), F.lit(6)),
    }
    return found.select("*", *[F.when(F.col("kind") >= len(BASE), v).alias(k) for k, v in values.items()])


def examples(spark: SparkSession, each: int = EXAMPLES) -> DataFrame:
    """Training sentences (row, text, label, part): ``each`` of every template; all sentences of a template are in one part."""
    listed = [(t, y, i % FOLDS) for y, some in ((1, PRIVATE), (0, PUBLIC)) for i, t in enumerate(some)]
    templates = F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.lit(y).alias("label"), F.lit(p).alias("part")) for t, y, p in listed]))
    made = spark.range(each).select("id", templates.alias("t")).select("id", "t.*")
    chars = F.translate(F.sha2(F.concat_ws("|", "id", "template"), 256), "abcdef", "135790")
    text = F.array_join(F.transform(F.split("template", ""), lambda c, i: F.when(c == "#", F.substring(chars, i + 1, F.lit(1))).otherwise(c)), "")
    lead = F.element_at(F.array(*map(F.lit, ["", "The ", "and then, ", "Der Text "])), (F.col("id") % 4 + 1).cast("int"))
    return made.select(F.xxhash64("id", "template").alias("row"), F.concat(lead, text).alias("text"), "label", "part")


def _vectors(spark: SparkSession, each: int) -> list[tuple[dict, int, float, int]]:
    """Distinct feature vectors of the examples, with label, count and part; bounded by the templates' few formats."""
    found = with_features(candidates(examples(spark, each))).where(F.col("kind") >= len(BASE))
    rows = [r.asDict() for r in found.groupBy("label", "part", *FEATURES).count().collect()]
    return sorted((({f: r[f] for f in FEATURES}, r["label"], float(r["count"]), r["part"]) for r in rows), key=str)


def _unseen(table: list[tuple[dict, int, float, int]]) -> list[tuple[int, float, int, float]]:
    """(kind, margin, label, weight) of every vector, by trees that saw no example of its template."""
    out = []
    for part in range(FOLDS):
        trees = boosting.fit([r[:3] for r in table if r[3] != part], FEATURES, **TREES)
        out += [(row["kind"], trees.margin(row), y, w) for row, y, w, p in table if p == part]
    return out


def thresholds(unseen: list[tuple[int, float, int, float]], precision: float) -> dict[int, float]:
    return {k: boosting.threshold([r[1:] for r in unseen if r[0] == k], precision) for k in range(len(BASE), len(KINDS))}


def train(spark: SparkSession, each: int = EXAMPLES, precision: float = PRECISION) -> tuple[boosting.Model, dict[int, float]]:
    """The boosted trees, fitted on all examples, and for each generator the threshold from which on templates not seen are right by ``precision``."""
    table = _vectors(spark, each)
    return boosting.fit([r[:3] for r in table], FEATURES, **TREES), thresholds(_unseen(table), precision)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[boosting.Model, dict[int, float]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and found (array of kind, start, end, score), one row per row."""
    trees, limits = model or train(docs.sparkSession)
    least = F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = with_features(candidates(rows)).withColumn("base", F.coalesce(_well_formed(), F.lit(False)))
    scored = scored.withColumn("score", F.when(F.col("base"), 1.0).when(F.col("kind") >= len(BASE), F.expr(trees.sql())))
    scored = scored.withColumn("rank", F.when(F.col("base"), 0).when(F.col("score") >= least, F.col("kind")))
    scored = scored.withColumn("key", F.coalesce("start", F.lit(0)))
    before = Window.partitionBy("row").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("key"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.lit(False)
    for rank in (0, *range(len(BASE), len(KINDS) - 1)):  # a span gives way to those of a lower rank
        mine = F.when(F.col("rank") == rank, True)
        reached, next_start = F.max(F.when(mine, F.col("end"))).over(before), F.min(F.when(mine, F.col("start"))).over(after)
        hit = hit | ((F.col("rank") > rank) & (F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(next_start < F.col("end"), F.lit(False))))
    chosen = scored.withColumn("kept", F.col("rank").isNotNull() & ~hit)
    span = F.struct("kind", "start", "end", "score")
    counts = [F.sum((F.col("base") & (F.col("kind") == i)).cast("long")).alias(f"n_{k}") for i, k in enumerate(BASE)]
    grouped = chosen.groupBy("row", "doc_id").agg(*counts, F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("found"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = text(F.filter("found", lambda s: s["kind"] < len(BASE)))
    return grouped.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(base, 256).alias("base_sha256"), text(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, text_col: str = "text", model: tuple[boosting.Model, dict[int, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` with every span of their text replaced by its kind in brackets; overlapping spans by the first one's.

    A null text stays null. Rows are numbered and written once, so that spans meet their texts again; other columns are kept, whatever their names.
    """
    row = C.new_name(docs, "row")
    numbered = C.staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = find(numbered.where(F.col(text_col).isNotNull()), row, text_col, model).where(F.size("found") > 0)
    held = C.new_name(numbered, "spans")
    listed = F.array_sort(F.transform("found", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    joined = numbered.join(found.select(F.col("doc_id").alias(row), listed.alias(held)), row, "left")
    names, text = F.array(*map(F.lit, KINDS)), F.col(text_col)
    reached = C.prefixes(F.transform(held, lambda s: s["end"]), F.lit(0), F.greatest)
    piece = lambda s, at: F.when(
        s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
    ).otherwise("")
    last = F.array_max(F.transform(held, lambda s: s["end"]))
    changed = F.concat(F.array_join(F.zip_with(F.col(held), reached, piece), ""), F.substring(text, last + 1, F.length(text)))
    return joined.withColumn(text_col, F.when(F.col(held).isNull(), text).otherwise(changed)).select(*[joined[c] if c != text_col else F.col(c) for c in docs.columns])


def op9_pii(spark, sf_dir):
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
