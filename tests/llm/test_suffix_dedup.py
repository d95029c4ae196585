import random

import numpy as np
import pytest

from quillspark.llm import _common
from quillspark.llm import _text as T
from quillspark.llm import suffix_dedup as D


def brute(rows, n=50):
    words = [(i, (t or "").split()) for i, t in rows]
    held = {}
    for r, (i, w) in enumerate(words):
        for s in range(len(w) - n + 1):
            held.setdefault(tuple(w[s : s + n]), set()).add(("null", r) if i is None else i)
    out = []
    for i, w in words:
        run = None
        for s in range(len(w) - n + 1):
            if len(held[tuple(w[s : s + n])]) > 1:
                if run and s <= run[1]:
                    run[1] = s + n
                else:
                    run = [s, s + n]
                    out.append((i, run))
    return sorted(((i, a, b, b - a) for i, (a, b) in out), key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(90):
        t = [word() for _ in range(rng.randrange(0, 90))]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = p[rng.randrange(0, 2) :]
        rows.append((i, " ".join(t)))
    rows += [(100, "the " * 300), (101, "the " * 200), (102, "of " * 300)]
    left = [word() for _ in range(45)]
    right = [word() for _ in range(45)]
    # Neighbours on the right that differ on the left, and the other way round.
    rows += [(110 + k, " ".join(left[k * 9 :] + right[: 45 - k * 9] + [f"z{k}"])) for k in range(5)]
    return rows


@pytest.mark.parametrize("parts,hot", [(1, 1000), (7, 1000), (4, 5)])
def test_against_brute_force(spark, documents, monkeypatch, parts, hot):
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    monkeypatch.setattr(T, "SPAN", 4_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = corpus()
        got = D.repeated_passages(documents([(i, t, "s") for i, t in rows]).repartition(parts)).select("doc_id", "start_word", "end_word", "n_words").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_near_copies_with_edits(spark, documents):
    """Copies that differ from each other on both sides of what they share: neighbours alone don't settle them."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = rng.choice(["x", "y", f"own{i}"])
        rows.append((i, " ".join(t)))
    got = D.repeated_passages(documents([(i, t, "s") for i, t in rows])).select("doc_id", "start_word", "end_word", "n_words").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("hot", [1000, 5])
def test_settled_stretches_are_looked_up_once_a_run(spark, documents, monkeypatch, hot):
    """Near copies, some twice in a document, in two rows of an id or without one: only what neighbours leave open, and one of each run that they
    have settled, is looked up, not every stretch of every document around the same minimiser (before: over 70 a document here)."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(300):
        t = base * (1 + (i % 10 == 0))
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = rng.choice(["x", "y", f"own{i}"])
        rows.append((None if i % 13 == 0 else i // 2 if i % 3 == 0 else 1000 + i, " ".join(t)))
    looked, real = [], D.cut

    def cut(df, **kw):
        out = real(df, **kw)
        if {"f1", "pos"} <= set(df.columns):
            looked.append(out.count())
        return out

    monkeypatch.setattr(D, "cut", cut)
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    got = D.repeated_passages(documents([(i, t, "s") for i, t in rows]).repartition(7)).select("doc_id", "start_word", "end_word", "n_words").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert 0 < sum(looked) < 20 * len(rows)


def test_characters_and_copies(documents):
    text = "é " + " ".join(f"w{i}" for i in range(60)) + "\tend."
    rows = [(1, text), (2, text), (2, text), (3, "x " + text), (4, None), (5, ""), (None, text)]
    docs = documents([(i, t, "s") for i, t in rows])
    passages = D.repeated_passages(docs)
    assert sorted((str(r.doc_id), r.n_words) for r in passages.collect()) == [("1", 62), ("2", 62), ("3", 62), ("None", 62)]
    for r in D.with_characters(docs, passages).collect():
        t = "x " + text if r.doc_id == 3 else text
        assert t[r.start_char : r.end_char] == r.passage and r.passage.split() == t.split()[r.start_word : r.end_word]


def test_texts_without_an_id(documents):
    text, other = " ".join(f"w{i}" for i in range(70)), " ".join(f"v{i}" for i in range(49))
    got = D.repeated_passages(documents([(None, text, "s"), (None, text, "s"), (None, other, "s"), (None, other, "s"), (1, other, "s")])).collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in got] == [(None, 0, 70)]


def test_one_document_alone(documents, edges):
    assert D.repeated_passages(documents([(1, "a b c d " * 100, "s"), (1, "a b c d " * 100, "s")])).count() == 0
    assert D.repeated_passages(documents([]).where("false")).count() == 0
    assert D.repeated_passages(edges).count() == 0


@pytest.mark.parametrize("n,w", [(0, 3), (2, 3), (3, 3), (20, 1), (50, 7)])
def test_sliding_least(n, w):
    x = np.random.default_rng(n).integers(0, 99, n).astype(np.uint64)
    least, at = D.sliding_least(x, w)
    parts = [list(x[i : i + w]) for i in range(max(0, n - w + 1))]
    assert list(least) == [min(p) for p in parts] and list(at) == [i + p.index(min(p)) for i, p in enumerate(parts)]
    same = np.zeros(n, dtype=np.uint64)
    assert list(D.sliding_least(same, w)[1]) == list(range(max(0, n - w + 1)))
