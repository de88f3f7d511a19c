import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stepforge.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = budget - sum(out.values())
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap * sizes[s]}
        if not over:
            return out | part
        out |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over
    return out


def brute_mix(rows, precision):
    queues = {}
    for d, text, s in rows:
        key = hashlib.md5(f"{'-' if d is None else d}:{text or ''}".encode()).hexdigest()[:16]
        queues.setdefault(s, []).append((key, d is not None, d or 0, n_words(text), d))
    sizes = {s: sum(x[3] for x in q) for s, q in queues.items()}
    aims, pieces = brute_targets(sizes), []
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    for s, q in queues.items():
        q.sort(key=lambda x: x[:4])
        longest, at = max(1, int(precision * aims[s])), 0
        for turn in range(2 if aims[s] > sizes[s] else 1):
            for i, x in enumerate(q):
                for start in range(0, x[3], longest):
                    n = min(longest, x[3] - start)
                    at += n
                    pieces.append((at / aims[s], rank[s], s, i, n))
    left, taken = int(1.5 * sum(sizes.values())), {(s, i): 0 for s, q in queues.items() for i in range(len(q))}
    for _, _, s, i, n in sorted(pieces):
        taken[s, i] += min(n, left)
        left -= min(n, left)
    return sorted(repr((x[4], s, x[3], sizes[s], round(aims[s], 6), taken[s, i])) for s, q in queues.items() for i, x in enumerate(q))


def found(df, precision):
    return sorted(repr((r.id, r.source, r.size, r.source_size, round(r.target, 6), r.taken)) for r in mixing.mix(df, precision=precision).collect())


@pytest.mark.parametrize("precision", [1e-3, 0.05, 1.0])
def test_against_a_loop(spark, precision):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i * 7 % 23)), "abcde"[i % 5] if i % 9 else "a") for i in range(150)]
    rows += [(500, None, "a"), (501, " \t\n", None), (502, "x " * 3000, "d"), (None, "no id", None), (503, "é x y", None), (7, "twin twin", "b"), (7, "twin twin", "b"), (504, "", "empty")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("size", "target", "upto", "rank", "__at")})
    assert found(df, precision) == brute_mix(rows, precision)


def test_sources_come_near_their_targets(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pow(hash(id) % 40, 2) as int))").alias("text"),
        F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source")
    )
    out = mixing.mix(rows).collect()
    budget = 1.5 * sum(r.size for r in out)
    assert sum(r.taken for r in out) == int(budget) and all(r.taken <= 2 * r.size for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 + 0.003 * own[0].target
    assert {(r.id, r.taken) for r in mixing.mix(rows.repartition(7)).collect()} == {(r.id, r.taken) for r in out}


def test_the_schedule_is_in_proportion_all_along(spark):
    rows = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(400)], SCHEMA)
    queued = mixing.queues(rows)
    aims = mixing.targets(queued.groupBy("source").agg(F.sum("size").alias("source_size")))
    aim = {r.source: r.target for r in aims.collect()}
    plan = mixing.schedule(queued, aims).orderBy("place").collect()
    assert [p.place for p in plan[1:]] == [p.place + p.words for p in plan[:-1]]
    half = {s: sum(p.words for p in plan[: len(plan) // 2] if p.source == s) for s in aim}
    assert abs(half["a"] / half["b"] - aim["a"] / aim["b"]) < 0.05


def test_targets_stop_at_the_cap(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1000, None: 0}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i}": (i * 37) % 11 * 100 for i in range(12)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        assert {r.source: pytest.approx(r.target) for r in mixing.targets(df).collect()} == brute_targets(sizes)


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == []
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)).collect()] == [0, 0]
