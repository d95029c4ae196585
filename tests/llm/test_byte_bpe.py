import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import byte_bpe as B


@pytest.fixture(scope="module")
def both():
    ranks = B.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return B.Coder(ranks, B.merge_table(ranks), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(both, texts):
    ids, decoded = both[0].run(texts)
    for t, i, d in zip(texts, ids, decoded):
        assert np.frombuffer(i, "<u4").tolist() == both[1].encode_ordinary(t) and d.decode() == t


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=40, deadline=None)
def test_any_text(both, texts):
    check(both, texts)


def test_long_words(both):
    rng = random.Random(4)
    check(both, ["", "a" * 1001, " " * 777, "ab" * 500, "!?" * 300 + "é" * 200, "日本語" * 100, "".join(rng.choice("abcdefgh") for _ in range(3000)), "<|endoftext|>"])


def test_small_cache(both, monkeypatch):
    ranks = both[0].ranks
    small = B.Coder(ranks, B.merge_table(ranks), P.PATTERN, cache_words=3)
    monkeypatch.setattr(B, "SLICE_CHARS", 10)
    check((small, both[1]), ["one two three four five", "one six", "two seven eight", "one"])


def test_query(spark, documents, write, both):
    from conftest import EDGES  # noqa: F401

    rows = EDGES
    got = B.op10_query(spark, write(documents=documents(rows))).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(both[1].encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_vocabulary_that_lacks_a_byte_raises():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b" ": 3}
    coder = B.Coder(ranks, B.merge_table(ranks), r"\S+|\s+")
    assert coder.run(["ab a"]) == ([np.array([2, 3, 0], "<u4").tobytes()], [b"ab a"])
    with pytest.raises(ValueError, match="byte"):
        coder.run(["abz z"])


def test_empty_table(spark, documents):
    assert B.encode(documents([]).where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_decoding_reads_the_ids(both):
    ids, _ = both[0].run(["first text", "", "second"])
    assert both[0].decode(ids[::-1]) == [b"second", b"", b"first text"]


def test_more_words_than_one_query_takes(both, monkeypatch):
    monkeypatch.setattr(B, "QUERY_WORDS", 7)
    fresh = B.Coder(both[0].ranks, B.merge_table(both[0].ranks), P.PATTERN)
    check((fresh, both[1]), [" ".join(f"word{i}x{i * 7919}" for i in range(60)), " ".join("y" * (50 + i) for i in range(20))])
