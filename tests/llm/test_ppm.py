import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stepforge.llm import ppm


class Slow:
    """The model by its definition: a dictionary trie, method C, exclusion by sets."""

    def __init__(self, texts, order, share):
        self.order, self.trie, total = order, defaultdict(Counter), 0
        for t in texts:
            s = "\n" * order + self.form(t)
            total += len(s) - order
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.trie[s[i - j : i]][s[i]] += 1
        for c, seen in self.trie.items():
            if len(c) > 1:
                for x in [x for x, n in seen.items() if n * share < total]:
                    del seen[x]

    @staticmethod
    def form(t):
        return " ".join(w.decode("latin1") for w in (t or "").encode().lower().split()) + "\n"

    def byte(self, context, sym):
        p, gone = 1.0, set()
        for j in range(self.order, -1, -1):
            seen = self.trie.get(context[len(context) - j :] if j else "", {})
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in gone}
            escape = max(1, len(left))
            total = sum(left.values()) + escape
            if sym in left:
                return p * left[sym] / total
            p *= escape / total
            gone |= set(seen)
        return p / max(1, 256 - len(gone))

    def score(self, t):
        s = "\n" * self.order + self.form(t)
        return sum(math.log10(self.byte(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


TEXTS = [None, "", " \n ", "Abra cadabra abra", "abra  cad abra\tÉ é", "x" * 500, "zq"]


@pytest.mark.parametrize(("order", "share"), [(3, 1 << 22), (5, 60), (1, 5)])
def test_against_the_definition(spark, order, share):
    rng = random.Random(order)
    word = lambda: "".join(rng.choice("ab é"[: rng.randrange(2, 5)]) for _ in range(rng.randrange(1, 5)))
    texts = TEXTS + [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)] + [(None, "abra", None, None), (9, "abra", "", 0)], "doc_id long, text string, row string, key int")
    held = ppm.fold("doc_id", 7) == 2
    rows = ppm.score_documents(docs, ppm.learn(docs.where(~held), order=order, share=share), held_out=held).collect()
    pairs = [*enumerate(texts), (None, "abra"), (9, "abra")]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in pairs}
    train = [t for i, t in pairs if not out[i]]
    slow = Slow(train, order, share)
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    counts = Counter(x for t in train for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (
            (i if i is not None else -1, out[i], len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), slow.score(t)
        ) for i, t in pairs
    )
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score) for r in rows)
    assert [g[0] for g in got] == [e[0] for e in expected]
    np.testing.assert_allclose([g[1:] for g in got], [e[1:] for e in expected], atol=2e-5, rtol=1e-6)


def test_probabilities_sum_to_one():
    slow = Slow(TEXTS, 2, 1 << 22)
    for context in ("ab", "\n\n", "qq", "a "):
        assert abs(sum(slow.byte(context, chr(b)) for b in range(256)) - 1) < 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ppm.learn(none)
    assert ppm.score_documents(none, model).count() == 0
    r = ppm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, round(-4 * math.log10(256), 6))


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    find = ppm.Lookup(keys)
    assert find.find(keys).tolist() == list(range(len(keys)))
    assert set(find.find(keys + np.uint64(1)).tolist()) <= {-1}


def test_a_rare_entry_stays_in_a_large_corpus(spark):
    # over 2**22 positions: entries seen once were dropped, so their text was scored by escapes
    docs = spark.createDataFrame([(1, "a " * 2_200_000), (2, "qzj kxw")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.score_documents(docs, ppm.learn(docs)).collect()}
    assert abs(got[2] - (math.log10(1 / 4) + 7 * math.log10(1 / 2))) < 1e-5


@pytest.mark.parametrize(("table", "share"), [(0, None), (25, None), (25, 60)])
def test_what_is_not_broadcast_is_joined(spark, table, share):
    rng = random.Random(table)
    texts = TEXTS + [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    train = docs.where("doc_id % 3 > 0")
    model = ppm.learn(train, share=share, table=table)
    assert len(model["grams"][1]) <= table
    slow = Slow([t for i, t in enumerate(texts) if i % 3], ppm.ORDER, share or math.inf)
    got = {r.doc_id: r.score for r in ppm.score_documents(docs, model).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(texts))], [slow.score(t) for t in texts], atol=2e-5, rtol=1e-6)
