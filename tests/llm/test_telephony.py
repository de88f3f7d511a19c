import hashlib
import zlib

import numpy as np

from stepforge.llm import telephony as T


def one_block(block):
    """IMA ADPCM by the book, a nibble at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            diff = step >> 3
            diff += step if code & 4 else 0
            diff += step >> 1 if code & 2 else 0
            diff += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(T.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_tables():
    u, a = T.TABLES["ulaw"], T.TABLES["alaw"]
    assert (u[0], u[0x7F], u[0x80], u[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(a.tolist())) == 256 and len(set(u.tolist())) == 255


def test_adpcm_and_files():
    raw = np.random.default_rng(1).integers(0, 256, (50, 64)).astype(np.uint8)
    assert T.adpcm_decode(raw).tolist() == [one_block(bytes(b)) for b in raw]
    for codec in T.FORMATS:
        assert T.unwav(T.wav(raw.tobytes(), codec)) == (codec, 8000, raw.tobytes())


def test_round_trip(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é\0ñ", "long text " * 30000, "a" * 64]
    docs = spark.createDataFrame([(i, t, b"x", "y") for i, t in enumerate(texts)] + [(None, "q", None, None)], "doc_id long, text string, media binary, payload string")
    rows = T.text_recordings(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = T.wav(padded, "ulaw")
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        law = T.TABLES["ulaw"][np.frombuffer(padded, np.uint8)].astype(int)
        after = np.append(law[1:], law[-1])
        pcm = np.stack([law, (law + after) >> 1], 1).ravel().astype("<i2").tobytes()
        assert r.feature.endswith(f"pcm16k={zlib.crc32(pcm):08x}")
        stored = T.wav(pcm, "pcm16", 16000)
        assert (r.pcm_bytes, r.pcm_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        other = T.TABLES["alaw"][np.frombuffer(padded, np.uint8)].astype(int)
        wide = [v for j in range(0, len(padded), 64) for v in one_block(padded[j : j + 64])] if len(padded) < 9999 else T.adpcm_decode(np.frombuffer(padded, np.uint8).reshape(-1, 64)).astype(int).ravel().tolist()
        assert f";alaw={(other**2).sum() // len(other)};adpcm={sum(v * v for v in wide) // len(wide)};peak={abs(law).max()};" in r.feature
        assert f";ulaw={(law**2).sum() // len(law)};" in r.feature
        assert f";zc={((law[1:] < 0) != (law[:-1] < 0)).sum()};" in r.feature
    assert got[2].feature == got[6].feature


def test_stored_and_expanded(spark, monkeypatch):
    raw = bytes(range(256))
    df = spark.createDataFrame([(1, raw, 0), (2, None, 0), (3, b"", 0), (None, raw * 3, 0)], "id long, payload binary, media int")
    for codec in ("ulaw", "alaw", "ima_adpcm", "pcm16"):
        out = {r.id: r.pcm for r in T.expand_recordings(T.store_samples(df, codec=codec)).collect()}
        kind, rate, pcm = T.unwav(out[1])
        assert (kind, rate, len(T.unwav(out[3])[2])) == ("pcm16", 16000, 0)
        law = T.TABLES.get(codec)
        expected = np.frombuffer(raw, "<i2") if codec == "pcm16" else law[np.frombuffer(raw, np.uint8)] if law is not None else np.ravel([one_block(raw[i : i + 64]) for i in range(0, 256, 64)])
        assert np.frombuffer(pcm, "<i2")[::2].tolist() == expected.tolist() and np.frombuffer(pcm, "<i2")[-1] == expected[-1]
        assert np.frombuffer(T.unwav(out[None])[2], "<i2")[::2].tolist() == expected.tolist() * 3
    assert T.text_recordings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_files_of_all_kinds_are_decoded_together(monkeypatch):
    rng = np.random.default_rng(2)
    files, want = [], []
    for i in range(40):
        codec, rate = list(T.FORMATS)[i % 4], 8000 + i
        raw = rng.integers(0, 256, 64 * int(rng.integers(0, 4)) + (i % 3 if codec != "ulaw" else 0)).astype(np.uint8).tobytes()
        files.append(T.wav(raw, codec, rate))
        want.append(T.expanded([files[-1]])[0])
        assert T.unwav(want[-1][0])[1] == 2 * rate
    assert T.expanded(files) == want


def test_malformed_files(spark):
    good = T.wav(b"abcd" * 16, "ulaw")
    stereo, foreign, wide = bytearray(good), bytearray(good), bytearray(good)
    stereo[22], foreign[20], wide[34] = 2, 85, 16
    odd = T.wav(b"abcde", "pcm16")
    files = [None, b"", b"RIFF", b"not a wav file at all", good[:30], good[:-9], bytes(stereo), bytes(foreign), bytes(wide), good[:12], odd, good]
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(files)], "id long, media binary, pcm string")
    got = [(r.pcm is not None, r.problem) for r in T.expand_recordings(df).orderBy("id").collect()]
    assert got == [
        (False, None), (False, "not a WAV file"), (False, "not a WAV file"), (False, "not a WAV file"), (False, "the file ends early"), (False, "the file ends early"), (False, "more than one channel"),
        (False, "unknown format"), (False, "samples of another size"), (False, "no samples in the file"), (True, None), (True, None),
    ]
    assert len(T.unwav(T.expanded([odd])[0][0])[2]) == 8
