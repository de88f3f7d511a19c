import random
import zlib

import numpy as np

from stepforge.llm import language_id as L

SYLLABLES = {"aa": "ka to mi ne su ra".split(), "bb": "sch ung ein ich ver tz".split(), "cc": "ñas ción lle rra que dor".split()}


def sentence(rng, lang, words=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = L.new_network(["a", "b", "c"], hidden=3)
    net.tables, net.recurrent = [t.astype(np.float64) for t in net.tables], [u.astype(np.float64) for u in net.recurrent]
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    x, live, _ = L.windows(rng.integers(97, 101, 17).astype(np.uint8), np.array([0, 7, 17]), 6)
    y = np.array([0, 2, 1, 1])[: x.shape[1]]
    _, grads = L.gradients(net, x, live, y)
    for p, g in zip(net.parameters(), grads):
        spots = np.argsort(-np.abs(g).ravel())[:4]
        for s in spots:
            at = np.unravel_index(s, p.shape)
            eps, was = 1e-2, p[at]
            p[at] = was + eps
            up = L.gradients(net, x, live, y)[0]
            p[at] = was - eps
            down = L.gradients(net, x, live, y)[0]
            p[at] = was
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_windows_hold_every_byte_once():
    raw = np.arange(50).astype(np.uint8)
    x, live, owner = L.windows(raw, np.array([0, 0, 20, 21, 50, 50]), 8)
    assert sorted(x[live > 0].tolist()) == list(range(50)) and owner.tolist() == [1, 1, 1, 2, 3, 3, 3, 3]


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES))), lang, 0.5, "s") for i in range(500)]
    rows += [
        (1000, None, "aa", 0, "s"), (1001, "", "aa", 0, "s"), (1002, "12 ++ 3", "bb", 0, "s"), (None, sentence(rng, "bb"), None, 0, "s"),
        (1003, sentence(rng, "cc", 60000), "cc", 0, "s"), (1, rows[1][1], None, 0, "s")
    ]
    docs = spark.createDataFrame([(a, b, c, float(d), e) for a, b, c, d, e in rows], "doc_id long, text string, lang string, score double, letters string")
    held = L.fold("doc_id", 5) == 0
    net = L.train(docs.where(~held), epochs=4)
    out = L.identify(docs, net, held_out=held).collect()
    assert {r.doc_id for r in L.keep_known(docs, net, least=0.4).collect()} == {r.doc_id for r in out if r.lang_pred != "und"}
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[2]}
    tested = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(tested) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "cc" and by[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in out)
    same = [r for r in out if r.doc_id == 1]
    assert len(same) == 2 and same[0].score == same[1].score


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net = L.train(docs)
    assert net is None and L.identify(docs, net).collect()[0].lang_pred == "und" and L.identify(docs.limit(0), net).count() == 0


def test_pooled_probabilities_against_a_network_stepped_byte_by_byte():
    rng = np.random.default_rng(3)
    net = L.new_network(["aa", "bb", "cc"], hidden=3, seed=5)
    net.bias[:] = rng.standard_normal((3, 1))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(side, part):
        table, u, h, out = net.tables[side].astype(float), net.recurrent[side].astype(float), np.zeros(3), []
        for byte in part:
            gate, carried = table[:, byte], u @ h
            z, r = sigmoid(gate[:3] + carried[:3]), sigmoid(gate[3:6] + carried[3:6])
            h = z * h + (1 - z) * np.tanh(gate[6:] + r * carried[6:])
            out.append(h)
        return out

    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 8, 9, 30)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    pooled, votes = L.label(net, np.frombuffer(b"".join(texts), np.uint8), offsets, 8)
    for i, text in enumerate(texts):
        mass, own = np.zeros(3), np.zeros(3)
        for at in range(0, len(text), 8):
            part = text[at : at + 8]
            for ahead, back in zip(states(0, part), states(1, part[::-1])[::-1]):
                a = net.out @ np.concatenate([ahead, back]) + net.bias[:, 0]
                p = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
                mass += p
                own[p.argmax()] += 1
        assert np.allclose(pooled[i], mass, atol=1e-4) and (votes[i] == own).all()


def test_a_language_of_copies_and_one_of_few_texts_are_learned(spark):
    rows = [(i, "ka to mi ne su ra " * 9, "aa") for i in range(900)] + [(1000 + i, f"sch ung ein ich ver tz {i} " * 9, "bb") for i in range(3)]
    net = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50, epochs=1)
    assert net.languages == ["aa", "bb"]


def test_noise_is_told_from_languages_at_a_limit_read_off_unseen_texts(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, lang, rng.choice([4, 9, 40])), lang) for i in range(600) for lang in SYLLABLES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = L.fold("doc_id", 5) == 0
    net = L.train(docs.where(~held), with_noise=True)
    assert net.languages == ["aa", "bb", "cc", "und"]
    limit = L.noise_limit(docs.where(held), net)
    assert 0.5 < limit < 1
    mash = ["".join(rng.choice("qwxzjkvpfhg ") for _ in range(120)) for _ in range(20)]
    junk = mash + ["привет как дела сегодня хорошо", "今日は天気がいいですね", "QWRTPSDFG!! ZXCVBNM!! XWQZ!!", "12 34", None]
    told = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = L.keep_known(docs.where(held).unionByName(told), net, most_noise=limit).collect()
    assert not [r for r in kept if r.doc_id < 0]
    assert len(kept) >= docs.where(held).count() * 0.995
    assert {r.lang_pred for r in L.identify(told, net).collect()} <= {"aa", "bb", "cc", "und"}
    assert L.noise([], 5) == [] and L.noise_limit(docs.limit(0), net) == 1.0


def test_the_sample_is_bounded_at_any_size():
    for n in (1, 300, 10**6, 10**10, 10**13):
        drawn = n * L.hash_limit(n, 250) / 2**63
        assert drawn <= min(n, 376) and (n <= 375 or drawn > 374)
    rows = [(lang, h, f"t{h}") for lang in "ab" for h in range(900)] + [("c", 5, "only")]
    got = L.smallest(iter(rows), 250)
    assert got == [r for r in sorted(rows) if r[1] < 250] and len(L.smallest([], 250)) == 0
