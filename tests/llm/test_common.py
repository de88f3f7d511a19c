import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stepforge.llm import common as C
from stepforge.llm import packing, ppm

texts = st.lists(st.text(alphabet="aB é\t\n\x0b\x1c\x85\xa0z", max_size=25), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_hashes(docs):
    seen = {}
    with np.errstate(over="ignore"):
        for at, to, w in C.word_chunks(pa.array(docs, pa.string()), lower=True):
            raw = w.data.tobytes()
            for i in range(at, to):
                mine = [raw[a:b] for a, b in zip(w.starts[w.first[i - at] : w.first[i - at + 1]], w.ends[w.first[i - at] : w.first[i - at + 1]])]
                assert mine == docs[i].encode().lower().split()
            for word, h in zip((raw[a:b] for a, b in zip(w.starts, w.ends)), w.hashes().tolist()):
                assert seen.setdefault(word, h) == h
            grams = C.ngram_hashes(w.hashes(), 2)
            for i, g in enumerate(grams.tolist()):
                pair = tuple(raw[w.starts[j] : w.ends[j]] for j in (i, i + 1))
                assert seen.setdefault(pair, g) == g
            text, begin = ppm.normal_form(w)
            assert [text[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])] == [b" ".join(d.encode().lower().split()) + b"\n" for d in docs[at:to]]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 9))
def test_sliding(values, width):
    v = np.array(values, np.uint64)
    for fn, pad in ((np.minimum, np.uint64(99)), (np.maximum, np.uint64(0))):
        assert C.sliding(v, width, fn, pad).tolist() == [int(fn.reduce(v[i : i + width])) for i in range(len(v) - width + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_is_whole(lengths):
    bins = packing.pack(lengths, (8, 24, 64), 3)
    assert sorted(n for _, b in bins for n in b) == sorted(lengths)
    assert all(c == min(s for s in (8, 24, 64) if s >= sum(b)) for c, b in bins)


def test_slices_of_a_batch_and_nulls():
    column = pa.array(["zz", None, "a b", "c"]).slice(1)
    offsets, data = C.text_buffers(column)
    assert [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [b"", b"a b", b"c"]
