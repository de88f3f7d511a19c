import hashlib
import random
import re
from collections import Counter

from stepforge.llm.substring_dedup import dedup_substrings

SCHEMA = "doc_id long, text string, kmer string, edge string, id string"


def brute(texts, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def check(spark, texts, window, k):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    got = dedup_substrings(docs, window=window, k=k).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute(texts, window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_planted_passages(spark):
    rng = random.Random(1)
    word = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage, tail, copy = word(60), word(40), word(200)
    texts = [None, "", "a", word(34), copy, copy, copy, f"{word(50)} {passage} {word(9)}", f"{passage}\n{word(70)}", f"{word(5)} {passage} {word(5)} {passage}"]
    texts += [f"{word(30)} {passage[len(passage) // 3:]} {tail}", f"{tail} é {word(3)}", f"{word(4)} {tail}", word(3000) + " " + tail, "x " * 400, "\t".join(["é"] * 50)]
    for _ in range(6):
        w = copy.split()
        w[rng.randrange(200)] = "changed"
        texts.append(" ".join(w))
    check(spark, texts, 35, 12)


def test_small_alphabet(spark):
    rng = random.Random(2)
    for seed in range(2):
        check(spark, [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)], 7, 3)


def test_empty_table_and_repeated_rows(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    t = " ".join(str(i) for i in range(50))
    got = dedup_substrings(spark.createDataFrame([(None, t, "", "", ""), (7, t, "", "", ""), (7, t, "", "", ""), (7, "q " + t, "", "", "")], SCHEMA)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(50, 50)] * 3 + [(51, 50)]
