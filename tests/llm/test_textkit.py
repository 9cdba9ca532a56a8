import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sensemill.llm import textkit as K

ALPHABET = "ab é\t\nA日\x0b\x1f "


def _words(texts, table=K.PLAIN, most=1 << 20):
    out = []
    for _, data, offsets in K.pieces(pa.array(texts, pa.string()), most):
        w = K.split(data, offsets, table)
        for i in range(len(offsets) - 1):
            out.append([(w.word(j).decode(), int(w.hash[j])) for j in range(w.first[i], w.first[i + 1])])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=30)), max_size=8), st.sampled_from([1, 7, 1 << 20]))
def test_split(texts, most):
    got = _words(texts, most=most)
    assert [[w for w, _ in ws] for ws in got] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w, h in (x for ws in got for x in ws):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_runs(texts, n):
    want, got = [], []
    for t in texts:
        w = t.split()
        want += [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
    for _, data, offsets in K.pieces(pa.array(texts), 5):
        got += K.runs(K.split(data, offsets), n, short=True)[0].tolist()
    assert len(got) == len(want)
    pairs = dict(zip(want, got))
    assert all(pairs[w] == g for w, g in zip(want, got)) and len(set(pairs.values())) == len(pairs)


def test_slices_and_lower():
    a = pa.array(["x", "Ab cD", None, "ef"]).slice(1, 3)
    assert [[w for w, _ in ws] for ws in _words(a.to_pylist())] == [["Ab", "cD"], [], ["ef"]]
    lower = K.byte_table(K.BLANKS, lower=True)
    assert _words(["ABC"], lower)[0][0][1] == _words(["abc"], lower)[0][0][1] == K.word_hash("abc", lower=True)


def test_mix_is_a_bijection_on_a_sample():
    assert len(np.unique(K.mix(np.arange(100_000, dtype=K.U)))) == 100_000


def test_chunks_change_nothing(monkeypatch):
    """Words and runs that lie over the chunks' borders hash alike."""
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t") for _ in range(rng.randint(0, 200))) for _ in range(40)] + ["x" * 3000, "", " ", "ab " * 1000, "y" * 777 + " z"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    whole = K.split(data, offsets)
    runs = [K.runs(whole, 5, short=True, salt=3), K.runs(whole, 50)]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(K, "CHUNK", size)
        words = K.split(data, offsets)
        assert all((getattr(words, k) == getattr(whole, k)).all() for k in ("start", "end", "hash", "first"))
        for a, b in zip(runs, [K.runs(words, 5, short=True, salt=3), K.runs(words, 50)]):
            assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
