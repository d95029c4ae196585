import math
import random

import numpy as np
import pytest

from quillspark.llm import top_k as K


def brute(rows, k=5):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v[i] = [math.floor(256 * x) for x in e]
    out = []
    for q in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out += [(q, r + 1, c, -n) for r, (n, c) in enumerate(s[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, label int")


def test_against_brute_force(spark, write, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 40)
    monkeypatch.setattr(K, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(7)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1050, []), (1002, [float("nan")] * 7), (1003, [float("inf")] + [0.0] * 6), (1004, [None] * 7), (1100, [0.5] * 3), (1101, [0.5] * 3), (1150, [1.0])]
    assert sorted(map(tuple, K.op1_query(spark, write(embeddings=table(spark, rows))).collect())) == brute(rows)


def test_hot_vector_and_few_candidates(spark):
    rows = [(i, [0.5, 0.5]) for i in range(120)] + [(200, [1.0, 1.0])]
    v = K.quantised(table(spark, rows))
    assert sorted(map(tuple, K.search(v, v.where("id % 50 = 0")).collect())) == brute(rows)
    two = K.quantised(table(spark, [(0, [1.0]), (1, [2.0])]))
    assert [tuple(r) for r in K.search(two, two.where("id = 0")).collect()] == [(0, 1, 1, 256 * 512)]


def test_repeats_and_empty(spark):
    v = K.quantised(table(spark, [(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])]))
    assert sorted(map(tuple, K.search(v, v.where("id = 0")).collect())) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]
    assert K.search(v.where("false"), v.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 1.0]), (3, [-3e6, 5.0])]
    v = K.quantised(table(spark, rows))
    got = sorted(map(tuple, K.search(v, v.where("id = 0")).collect()))
    assert got == brute([(i, [float(x) for x in e]) for i, e in rows]) == [(0, r, c, s) for r, c, s in [(1, 1, (768000000**2) + 256 * 512), (2, 2, 768000000**2 + 256 * 256), (3, 3, -(768000000**2) + 256 * 1280)]]


@pytest.mark.parametrize("m", [1, 3, 9])
def test_slices_cover(m):
    assert sum((list(range(5))[s] for s in K._slices(5, m)), []) == list(range(5))


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_the_cutoff_leaves_work_out_but_no_candidate(spread):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 32))
    v = np.floor(256 * (middle[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 32)))).astype(np.int64)
    q, work = v[::50], []
    whole = q @ v.T
    t = np.sort(whole, axis=1)[:, -5]
    i, j, score = K.sufficient(q, v, t, K._slices(32, 4), K._bound(q, v), work)
    assert (whole[i, j] == score).all()
    got, want = set(zip(i.tolist(), j.tolist())), set(zip(*(x.tolist() for x in np.nonzero(whole >= t[:, None]))))
    assert want <= got and sum(work) <= whole.size * 32
    if spread < 1:
        assert sum(work) < 0.7 * whole.size * 32


def test_tiles_do_not_pass_the_driver(spark, write, monkeypatch):
    """Tables whose packed parts look small enough to broadcast, whatever their copies for all tiles take."""
    monkeypatch.setattr(K, "CHUNK", 10)
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(0, 200, 5)]
    found = K.op1_query(spark, write(embeddings=table(spark, rows)))
    assert sorted(map(tuple, found.collect())) == brute(rows)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
