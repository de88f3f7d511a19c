import hashlib
import re
import time

from stepforge.llm import secrets as S

SCHEMA = "doc_id long, text string, row string, weak string, n_chars long"
AWS = "AKIA" + "Q1W2E3R4T5Y6U7I8"
WEAK = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9z"


def brute(text, reach):
    """All pairs of parts, by the definition."""
    text = text or ""
    base = []
    for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""",
        text
    ):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base.sort()
    weak = S.weak_spans(text, base)
    role = {0: "S", 1: "A", 2: "S", 3: "A", 4: "S", 5: "E"}
    needs = {"S": "A", "A": "S", "E": "AS"}
    linked = [w for w in weak if all(any(role[p[1]] == n and p[0] < w[2] + reach and p[2] > w[0] - reach for p in base + weak) for n in needs[role[w[1]]])]
    return base, sorted(base + linked)


def test_against_pairs(spark):
    pad = "lorem ipsum " * 40
    texts = [
        None, "", "Token = \"abcdef\" pass", "PASSWORD: 'abc' apikey=abcdefg api_key=x", f"é {AWS} {WEAK}", f"{WEAK} alone", f"{AWS} {pad} {WEAK}",
        f"https://db.example.com/x {AWS} é secret=zzzzzz", f"https://db.example.com/x {AWS}", "b" * 24 + "é" + "a1" * 40, f"ABCDEFGHIJKLMNOP1 {WEAK} {pad} ABCDEFGHIJKLMNOP2",
        "toKen=abcdef", "api_?key=abcdefgh passwd = = x", (pad + WEAK + " ") * 60 + AWS, "q" * 50000, f"to {AWS}", "x.s3.amazonaws.com AKIA12 QWERTYUIOPASDFGH12 " + "0f" * 12,
    ]
    docs = spark.createDataFrame([(i, t, "r", "w", 1) for i, t in enumerate(texts)] + [(None, f"{AWS} {WEAK}", None, None, None), (0, AWS, "", "", 0)], SCHEMA)
    rows = S.scan(docs).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows if r.doc_id}
    for i, t in enumerate(texts[1:], 1):
        base, spans = brute(t, S.REACH)
        name = lambda xs: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in xs)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert r.spans == name(spans)
    assert any("random" in r.spans for r in rows) and any("endpoint" in r.spans for r in rows) and any("identifier" in r.spans for r in rows)


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, f"é {AWS} {WEAK} end", "r", "w", 9), (2, "clean", "r", None, 5), (2, "clean", "r", None, 5), (3, None, None, None, None), (None, "token=abcdef x", "", "", 14)],
        SCHEMA
    )
    out = S.redact(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect())
    assert got == [(0, "[assign] x", 10), (1, "é [access] [random] end", 23), (2, "clean", 5), (2, "clean", 5), (3, None, None)]
    assert S.redact(docs.limit(0)).count() == 0 and S.scan(docs.limit(0)).count() == 0


def test_weak_candidates_of_a_long_dump_and_their_overlaps():
    base = [(10 * i, i % 3, 10 * i + 7) for i in range(30_000)] + [(5, 1, 400)]
    text = " ".join(f"{i:05d}aB3dE5gH7jK9mN1pQ" for i in range(12_000))
    began = time.monotonic()
    some = S.weak_spans(text, sorted(base))
    assert time.monotonic() - began < 20
    near = sorted(base)[:500]
    part = text[:9000]
    assert S.weak_spans(part, near) == [x for x in S.weak_spans(part, []) if not any(b[0] < x[2] and x[0] < b[2] for b in near)]
    assert all(x in S.weak_spans(text, []) for x in some[:5])


def test_redact_keeps_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, 'token = "abcdef123456"', "r", "s", "f", 2), (2, None, "r", "s", "f", 0)], "doc_id long, text string, row string, spans string, found string, _row int")
    got = sorted(S.redact(docs).collect())
    assert [tuple(r) for r in got] == [(1, '[assign]"', "r", "s", "f", 2), (2, None, "r", "s", "f", 0)]
