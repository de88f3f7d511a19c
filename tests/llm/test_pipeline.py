import random

import corpus_pipeline as P

SYLLABLES = {"aa": "ka to mi ne su ra".split(), "bb": "sch ung ein ich ver tz".split()}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(2)
    item = sentence(rng, "aa", 40)
    rows = [(i, sentence(rng, lang := rng.choice("ab") * 2, rng.randrange(80, 200)), lang, "s") for i in range(150)]
    texts = {i: t for i, t, *_ in rows}
    rows += [(200, texts[3], "aa", "s"), (201, texts[3] + " ka", "aa", "s"), (202, "12 34", "aa", "s"), (203, None, "aa", "s"), (204, "", None, "s")]
    rows += [
        (205, texts[5] + " " + item, "bb", None), (206, sentence(rng, "bb", 90) + ' token = "abcdef123456" ver', None, "s"),
        (None, sentence(rng, "aa", 99), "aa", "s"), (7, sentence(rng, "aa", 50), "aa", "s")
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stage = dict(P.STAGES)
    known = stage["language_id"](spark, docs, str(tmp_path))
    assert known.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {202, 203, 204}
    assert [r.lang for r in known.where("doc_id = 206").collect()] == ["bb"]

    single = stage["simhash_near_dedup"](spark, known, str(tmp_path))
    kept = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and 200 not in kept and 3 in kept and None in kept and kept.count(7) == 2 and len(kept) > 140

    clean = stage["benchmark_decontamination"](spark, single, str(tmp_path))
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {205}

    safe = stage["secret_scans"](spark, clean, str(tmp_path))
    before, after = ({r.doc_id: r for r in d.collect()} for d in (clean, safe))
    assert safe.columns == docs.columns and set(before) == set(after)
    assert [i for i in before if before[i].text != after[i].text] == [206]
    assert after[206].text.endswith('[assign]" ver') and after[206].n_chars == len(after[206].text)

    packed = P.run(spark, str(tmp_path)).collect()
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for r in safe.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.split()) + 1
    assert sizes == want


def test_stages_on_empty_and_null_rows(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "words " * 9, None, None, None)]):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = {"language_id": 0, "simhash_near_dedup": 2 if rows else 0}.get(name, len(rows))
            assert out.count() == kept, name
