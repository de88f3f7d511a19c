import hashlib
import random
import time

from pyspark.sql import functions as F

from stepforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(8)
    bits = [
        "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[TURN 61]", "[/TURN]", "<|plain|>", "<|escaped|>", "&amp;", "&lt;", "&lsqb;", "&", "\\",
        "\n", " ", "é", "$1", "[", "<", "x", "\0"
    ]
    roles = ["user", "assistant", "system", "tool", "", None, "é]", "User"]
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(8))) if rng.random() > 0.05 else None, "f", "t"))
    rows += [
        (200, 0, "user", "plain text " * 20000, "", ""), (200, 1, "assistant", "[/INST] " * 9000, "", ""), (201, 0, "assistant", "</s>" * 9000, "", ""),
        (None, None, None, None, None, None)
    ]
    rows += [(202, 1, "user", "b", "", ""), (202, 1, "user", "a", "", ""), (202, 1, "user", "b", "", ""), (202, 0, "assistant", "z", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.with_loss_mask(chat.format_conversations(df)).collect()
    for r in out:
        source = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in source]
        own = any(chat.MARKS.get(x[2] or "", chat.OTHER)[1] in (x[3] or "") for x in source)
        assert r.escaped == own
        under = [r.formatted[s.start : s.end] for s in r.loss]
        for plain, entity in reversed(chat.ENTITIES):
            under = [u.replace(entity, plain) if r.escaped else u for u in under]
        assert under == [(x[3] or "") * (x[2] == "assistant") for x in source]
        assert [(s.offset, s.end > s.start) for s in r.loss] == [
            (len(chat.MARKS[x[2]][0]) if x[2] in chat.MARKS else 7 + 2 * len((x[2] or "").encode()), x[2] == "assistant" and bool(x[3])) for x in source
        ]
    assert len(out) == len({x[0] for x in rows})


def test_a_conversation_of_many_turns_takes_no_longer_by_turn(spark):
    rows = spark.range(100_000).select(
        F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("turn <s> é "), "id").alias("text")
    )
    began = time.monotonic()
    done = chat.with_loss_mask(chat.format_conversations(rows))
    r = done.select(F.size("turns").alias("n"), F.md5(chat.under_loss(done)).alias("h"), F.element_at("loss", -1).alias("last"), F.length("formatted").alias("size")).first()
    want = "".join(f"turn <s> é {i}" for i in range(1, 100_000, 2))
    assert (r.n, r.h, r["last"].end) == (100_000, hashlib.md5(want.encode()).hexdigest(), r.size - len("</s>"))
    assert time.monotonic() - began < 60


def test_grammar_is_strict(spark):
    df = spark.createDataFrame([("<|plain|>[INST]a[/INST]<s>b</s>",), ("<|plain|>[INST]a[/INST] <s>b</s>",), ("[INST]a[/INST]",), ("<|plain|>",)], "f string")
    assert [None if r.p is None else len(r.p) for r in df.select(chat.parse(F.col("f"), False).alias("p")).collect()] == [2, None, None, 0]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(spark):
    df = chat.with_loss_mask(chat.format_conversations(spark.createDataFrame([], SCHEMA)))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
