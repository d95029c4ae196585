import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import _text as T
from quillspark.llm._exchange import bucket_of, distinct, pack_counts, pack_keys, unpack_counts, unpack_keys

texts = st.lists(st.text(alphabet=" \t\n\x0babcé日😀 ", max_size=40), min_size=1, max_size=8)


def found(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_and_windows(x):
    for a, z, data, offsets in T.spans(pa.array(x), 32):
        w = T.words(data, offsets)
        raw = data.tobytes()
        own = [raw[s:e].decode() for s, e in zip(w.start, w.end)]
        assert own == [t for y in x[a:z] for t in found(y)]
        assert [list(w.doc).count(i) for i in range(z - a)] == [len(found(y)) for y in x[a:z]]
        same = {}
        for t, h in zip(own, w.hash):
            assert same.setdefault(t, h) == h
        assert len(set(same.values())) == len(same)
        h = T.window_hash(w.hash, 3)
        ok = T.windows_inside(w.first, len(h), 3)
        assert ok.sum() == sum(max(0, len(found(y)) - 2) for y in x[a:z])
        assert list(T.characters(data, offsets)) == [len(y) for y in x[a:z]]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_exchange_blobs(keys, n):
    k = np.array(keys, dtype=np.uint64)
    parts, place = distinct(k, n)
    flat = np.concatenate(parts)
    assert list(flat[place]) == keys and list(flat) == sorted(set(keys))
    for i, p in enumerate(parts):
        assert (bucket_of(p, n) == i).all() and list(unpack_keys(pack_keys(p))) == list(p)
    c = np.array([x % 700 for x in keys], dtype=np.int64)
    assert list(unpack_counts(pack_counts(c))) == list(c)
