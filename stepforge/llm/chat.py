"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is a header and its turns, each between the marks of its role. It is rendered
plainly, parsed back by the grammar, and the parsed turns are compared with the source; where they
differ the texts' control characters are escaped, and the result is parsed and compared again.
Escaped texts hold no character that begins a mark, so the second rendering always comes back; the
query fails rather than return a conversation that does not.

    conversation = ("<|plain|>" | "<|escaped|>") turn*
    turn = "<<SYS>>" text "<</SYS>>" | "[INST]" text "[/INST]" | "<s>" text "</s>" | "[TURN " hex "]" text "[/TURN]"

Defined results: a null text or role is empty; turns are in the order of (turn, role, text), nulls
first, so ties and repeated rows are kept and have one order; rows without conv_id form one
conversation; other columns are ignored. A conversation is rendered in one task: its turns are
one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PLAIN, ESCAPED = "<|plain|>", "<|escaped|>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN ", "[/TURN]")
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
_TURN = r"(?s)\G(?:<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[TURN [0-9A-F]*\].*?\[/TURN\])"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _open(role: Column) -> Column:
    found = F.concat(F.lit(OTHER[0]), F.hex(role), F.lit("]"))
    for name, (mark, _) in MARKS.items():
        found = F.when(role == name, F.lit(mark)).otherwise(found)
    return found


def _close(role: Column) -> Column:
    found = F.lit(OTHER[1])
    for name, (_, mark) in MARKS.items():
        found = F.when(role == name, F.lit(mark)).otherwise(found)
    return found


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of turns (role, text)."""
    body = F.transform(turns, lambda t: F.concat(_open(t["role"]), escape(t["text"]) if escaped else t["text"], _close(t["role"])))
    return F.concat(F.lit(ESCAPED if escaped else PLAIN), F.array_join(body, ""))


def _turn(s: Column, escaped: bool) -> Column:
    """One matched turn, taken apart."""
    out = None
    for name, (head, tail) in MARKS.items():
        text = F.substring(s, F.lit(len(head) + 1), F.length(s) - len(head) - len(tail))
        found = F.struct(F.lit(name).alias("role"), (unescape(text) if escaped else text).alias("text"))
        out = F.when(F.startswith(s, F.lit(head)), found) if out is None else out.when(F.startswith(s, F.lit(head)), found)
    end = F.instr(s, "]")
    text = F.substring(s, end + 1, F.length(s) - end - len(OTHER[1]))
    role = F.decode(F.unhex(F.substring(s, F.lit(len(OTHER[0]) + 1), end - len(OTHER[0]) - 1)), "UTF-8")
    return out.otherwise(F.struct(role.alias("role"), (unescape(text) if escaped else text).alias("text")))


def turn_texts(formatted: Column, escaped: Column | bool) -> Column:
    """A rendering split into its turns, marks included; text that is no turn is left out."""
    escaped = escaped if isinstance(escaped, Column) else F.lit(escaped)
    begin = F.when(escaped, F.lit(len(ESCAPED))).otherwise(F.lit(len(PLAIN))) + 1
    return F.regexp_extract_all(F.substring(formatted, begin, F.length(formatted)), F.lit(_TURN), F.lit(0))


def parse(formatted: Column, escaped: bool) -> Column:
    """The turns of a rendering, or null where the grammar does not cover all of it."""
    header = ESCAPED if escaped else PLAIN
    found = turn_texts(formatted, escaped)
    whole = F.length(F.array_join(found, "")) == F.length(formatted) - len(header)
    return F.when(F.startswith(formatted, F.lit(header)) & whole, F.transform(found, lambda s: _turn(s, escaped)))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, escaped and turns: the rendering, whether it is escaped, and the turns parsed back from it."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("source"))
    source = gathered.select("conv_id", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("formatted", render(F.col("source"), False)).withColumn("turns", parse(F.col("formatted"), False))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    again = plain.select(
        "conv_id", "source", (~same).alias("escaped"), F.when(same, F.col("formatted")).otherwise(render(F.col("source"), True)).alias("formatted"),
        F.when(same, F.col("turns")).alias("turns")
    )
    back = again.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"), True)).otherwise(F.col("turns")))
    failed = F.raise_error(F.lit("a conversation does not come back from its rendering")).cast("boolean")
    return back.where(F.when(F.col("turns") == F.col("source"), F.lit(True)).otherwise(failed)).select("conv_id", "formatted", "escaped", "turns")


def with_loss_mask(formatted: DataFrame) -> DataFrame:
    """``formatted`` with loss: for each turn the code points (start, end) of the rendering that count, end exclusive, and offset, where they begin in the turn.

    An assistant turn counts with its text, any other with nothing (start is end). Linear in the turns.
    """
    pieces = turn_texts(F.col("formatted"), F.col("escaped"))
    sizes = F.zip_with(
        pieces, "turns",
        lambda p, t: F.struct(F.length(p).alias("n"), F.length(_open(t["role"])).alias("o"), F.length(_close(t["role"])).alias("c"), (t["role"] == "assistant").alias("a"))
    )
    first = F.when(F.col("escaped"), F.lit(len(ESCAPED))).otherwise(F.lit(len(PLAIN)))
    span = lambda at, z: F.struct((at + z["o"]).alias("start"), (at + F.when(z["a"], z["n"] - z["c"]).otherwise(z["o"])).alias("end"), z["o"].alias("offset"))
    return formatted.withColumn("loss", C.let(sizes, lambda s: F.zip_with(C.prefixes(F.transform(s, lambda z: z["n"]), first, lambda a, b: a + b), s, span)))


def under_loss(masked: DataFrame) -> Column:
    """All text under the mask, unescaped, read out of the rendering."""
    read = F.zip_with(turn_texts(F.col("formatted"), F.col("escaped")), "loss", lambda p, s: F.substring(p, s["offset"] + 1, s["end"] - s["start"]))
    text = F.array_join(read, "")
    return F.when(F.col("escaped"), unescape(text)).otherwise(text)


def op3_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    done = with_loss_mask(format_conversations(rows.unionByName(says)))
    under = under_loss(done)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op3_chat_formatting": op3_chat_formatting}
ORACLE = {
    "op3_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/TURN]' END AS mark_end,
         CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 7 + 2 * strlen(role) END AS mark_size FROM rows),
conv AS (
  SELECT conv_id, count(*) AS n, bool_or(contains(text, mark_end)) AS esc,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS under,
         sum(mark_size + length(mark_end) + length(text)) AS plain_size,
         sum(mark_size + length(mark_end) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))) AS esc_size
  FROM marked GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(listed) AS turns_sha256, CAST(length(under) AS BIGINT) AS loss_chars, sha256(under) AS loss_sha256,
       CAST(CASE WHEN esc THEN 11 + esc_size ELSE 9 + plain_size END AS BIGINT) AS formatted_chars FROM conv"""
}
