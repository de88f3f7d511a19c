"""Operator 11: a Merkle manifest of a dataset, by slot pivot.

A tree for each group of rows, and one over the groups' roots. Going up, conditional aggregates spread the
children of a parent into as many columns as the fanout; the columns, concatenated, hash to the parent.
Going down, each column is turned back into a row whose siblings are the other columns. Rows of a group are
numbered by ranges, so a group of any size is dealt over many tasks, and every level is one aggregate by
parent: a level has a fanout-th of the rows of the one below.

H is the SHA-256 of its inputs concatenated, in lowercase hex; digests enter as hex text. A leaf's inputs
are its columns, each "-" if null, else the count of its UTF-8 bytes, ":" and the value as text. While a
tree has several nodes, every ``fanout`` consecutive ones become one (the last run may be shorter); a tree
of one node is that node, and so has an empty path.

Defined cases: rows ascend by id, null ids first, equal ids by leaf (rows equal throughout share their leaf
and may change places); a null group is a group, the first; a null or empty text gives a leaf as any other
value does; an empty table has no rows and no root; other columns of the table, whatever their names, do
not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Running, scan
from . import common as C

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def h(*parts: Column) -> Column:
    """SHA-256 of the parts concatenated, nulls left out, in lowercase hex."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf(columns: dict[str, Column]) -> Column:
    """A row's digest over named columns in their order."""
    text = [c.cast("string") for c in columns.values()]
    return h(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf up, as one text."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: h(s["left"], node, s["right"]))


def _numbered(rows: DataFrame, by: list[str], order_by: list) -> tuple[DataFrame, int]:
    """``rows`` with __at from 0 and __n, the size of their group, and the largest such size."""
    sizes = C.staged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    most = sizes.agg(F.max("__n")).first()[0] or 0
    placed = scan(rows, by, order_by, {"__at": Running("sum", F.lit(1))}, by_ranges=True)
    same = F.lit(True)
    for b in by:
        same = same & placed[b].eqNullSafe(sizes[b])
    return placed.join(sizes, same).select(*[placed[c] for c in rows.columns], (F.col("__at") - 1).cast("long").alias("__at"), "__n"), most


class Tree:
    """The levels of a forest: for each parent its children in slot columns s0, s1, …; ``tops`` are the nodes without a parent.

    ``rows`` has the columns tree, node (a digest) and any others, which stay with the children of the lowest level.
    """

    def __init__(self, rows: DataFrame, order_by: list, fanout: int):
        self.fanout, self.levels = fanout, []
        kept = [c for c in rows.columns if c not in ("tree", "node")]
        below, most = _numbered(rows, ["tree"], order_by)
        while True:
            self.levels.append(C.staged(self._pivoted(below, kept), f"level{len(self.levels)}"))
            most, kept = -(-most // fanout), []
            below = self.levels[-1].select("tree", "node", F.col("__up").alias("__at"), F.ceil(F.col("__kids") / fanout).alias("__n"))
            if most <= 1:
                break
        self.tops = below.select("tree", "node")

    def _pivoted(self, below: DataFrame, kept: list[str]) -> DataFrame:
        slot, child = F.pmod("__at", F.lit(self.fanout)), F.struct("node", *kept)
        spread = [F.max(F.when(slot == i, child)).alias(f"s{i}") for i in range(self.fanout)]
        wide = below.groupBy("tree", F.floor(F.col("__at") / self.fanout).alias("__up")).agg(*spread, F.max("__n").alias("__kids"))
        # a lone node of its tree is no parent's child: it goes up as it is
        return wide.withColumn("node", F.when(F.col("__kids") == 1, F.col("s0.node")).otherwise(h(*[F.col(f"s{i}.node") for i in range(self.fanout)])))

    def unpivoted(self, tops: DataFrame) -> DataFrame:
        """The rows of the lowest level with path, their siblings from below up, and what ``tops`` (tree, path, …) says of their tree."""
        more = [c for c in tops.columns if c not in ("tree", "path")]
        known = tops.withColumn("__up", F.lit(0).cast("long"))
        for wide in reversed(self.levels):
            met = wide.alias("w").join(known.alias("k"), F.expr("w.tree <=> k.tree and w.__up = k.__up"))
            slots = range(self.fanout)
            others = lambda own: [F.col(f"w.s{i}.node") for i in own]
            turned = [
                F.struct(
                    (F.col("w.__up") * self.fanout + i).alias("__up"), F.col(f"w.s{i}").alias("child"),
                    F.concat_ws("", *others(slots[:i])).alias("left"), F.concat_ws("", *others(slots[i + 1 :])).alias("right"),
                )
                for i in slots
            ]
            rows = met.select("w.tree", "w.__kids", "k.path", *[f"k.{c}" for c in more], F.inline(F.array(*turned))).where("child is not null")
            step = F.when(F.col("__kids") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast(_STEP))
            known = rows.select("tree", "__up", "child.*", F.concat(step, "path").alias("path"), *more)
            known = known if wide is self.levels[0] else known.drop("node")
        return known.drop("__up")


def manifest(docs: DataFrame, columns=COLUMNS, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, altered: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """id, group, leaf, altered_leaf, subroot, root and path of every row; path is an array of (left, right), siblings before and after.

    ``altered``: (condition, column → its value after a change); altered_leaf is the leaf of the changed row
    where the condition holds, null elsewhere. The trees are those of the unchanged rows.
    """
    if fanout < 2:
        raise ValueError("the fanout must be 2 at least")
    plain = {c: F.col(c) for c in columns}
    changed = F.when(altered[0], leaf(plain | altered[1])) if altered else F.lit(None).cast("string")
    leaves = docs.select(F.col(group_col).alias("tree"), leaf(plain).alias("node"), F.col(id_col).alias("id"), changed.alias("altered_leaf"))
    groups = Tree(C.staged(leaves, "leaves"), [F.col("id").asc_nulls_first(), "node"], fanout)
    subroots = groups.tops.select(F.lit(0).alias("tree"), "node", F.col("tree").alias("group"))
    over = Tree(subroots, [F.col("group").asc_nulls_first()], fanout)
    root = over.tops.select("tree", F.col("node").alias("root"), F.array().cast(_STEP).alias("path"))
    tops = over.unpivoted(root).select(F.col("group").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    return groups.unpivoted(tops).select("id", F.col("tree").alias("group"), F.col("node").alias("leaf"), "altered_leaf", "subroot", "root", "path")


def op11_merkle_manifest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = manifest(docs, altered=(hit, {"text": F.expr(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")}))
    out = out.withColumn("folded_root", folded(F.coalesce("altered_leaf", "leaf"), F.col("path")))
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", h(proof(F.col("path"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified")
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

# CRC-32 of a decimal number, bit by bit: each character is followed by eight shifts
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: "
    "[CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
)
_TEXT = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_ROW = lambda text: "sha256(" + " || ".join([*map(_TEXT, COLUMNS[:-1]), _TEXT(text)]) + ")"
ORACLE = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_ROW("text")} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_ROW(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
up(tree, l, place, n, node) AS (
  SELECT tree, 0, place, n, leaf FROM p
  UNION ALL
  SELECT tree, l + 1, place // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(node, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, l, place // {FANOUT}, n),
s AS (SELECT tree, node, count(*) OVER () AS n FROM up WHERE n = 1),
top(tree, l, place, n, node) AS (
  SELECT -1, 0, tree, n, node FROM s
  UNION ALL
  SELECT tree, l + 1, place // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY tree, l, place // {FANOUT}, n),
nodes AS (SELECT * FROM up UNION ALL SELECT * FROM top),
walk(r, tree, l, place, x, sib, own) AS (
  SELECT r, tree, 0, place, coalesce(altered, leaf), '', tree FROM p
  UNION ALL
  SELECT w.r, CASE WHEN max(u.n) = 1 THEN -1 ELSE w.tree END, CASE WHEN max(u.n) = 1 THEN 0 ELSE w.l + 1 END, CASE WHEN max(u.n) = 1 THEN w.own ELSE w.place // {FANOUT} END,
         CASE WHEN max(u.n) = 1 THEN w.x ELSE sha256(string_agg(CASE WHEN u.place = w.place THEN w.x ELSE u.node END, '' ORDER BY u.place)) END,
         w.sib || coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (WHERE u.place <> w.place), ''), w.own
  FROM walk w JOIN nodes u ON u.tree = w.tree AND u.l = w.l AND u.place // {FANOUT} = w.place // {FANOUT}
  WHERE NOT (w.tree = -1 AND u.n = 1) GROUP BY w.r, w.tree, w.l, w.place, w.x, w.sib, w.own),
ended AS (SELECT w.r, w.x, w.sib, t.node AS root FROM walk w JOIN top t ON w.tree = -1 AND t.n = 1 AND w.l = t.l)
SELECT p.doc_id, p.leaf, s.node AS subroot, e.root, sha256(e.sib) AS proof_sha256, e.x AS folded_root, e.x = e.root AS verified
FROM p JOIN s USING (tree) JOIN ended e USING (r)"""
}
