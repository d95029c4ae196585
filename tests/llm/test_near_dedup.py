import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quillspark.llm import near_dedup as N


def multiset(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    o = sum((a & b).values())
    return o >= 0.8 * (a.total() + b.total() - o) - 1e-9 and o > 0


def components(texts):
    sets, root = {i: multiset(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] == texts[b] or similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.random()}"
    return " ".join(words)


def test_families_against_brute_force(documents):
    rng, texts = random.Random(3), {}
    for f in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            texts[len(texts)] = edited(base, rng, rng.randrange(7))
        texts[len(texts)] = " ".join(base)
        texts[len(texts)] = " ".join(base)
    texts |= {1000: "a a a a a a a a a b", 1001: "a a a a a a a a a a", 1002: "x y", 1003: "x  y", 1004: "", 1005: ""}
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents([(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == components(texts)


def test_blocks_of_a_large_bucket(documents, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_DOCS", 20)
    rng, texts = random.Random(5), {}
    base = [f"w{i}" for i in range(100)]
    for _ in range(150):
        texts[len(texts)] = edited(base, rng, rng.randrange(1, 5))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents([(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == components(texts)


def test_edges(edges):
    rows = N.near_duplicates(edges).collect()
    assert len(rows) == 10
    by = defaultdict(set)
    for r in rows:
        by[r.class_id].add(r.doc_id)
    assert by[None] == {None} and by[7] == {7, 8} and by[1] == {1, 2} and by[3] == {3}


def test_empty(documents):
    assert N.near_duplicates(documents([]).where("false")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    m = 4000
    sig = N.bag_min_hash(np.concatenate([h, h]), np.repeat([0, 1], 60), np.concatenate([a, b]), 2, m)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_band_keys_do_not_depend_on_the_batch():
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 40, 200, 900]))) for _ in range(600)]
    texts[5] = "a b c d e " * 3000

    def keys(some):
        k, offsets = N.band_keys(pa.array(some), N.BANDS, N.ROWS, N.SHINGLE)
        return [k[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]

    full = keys(texts)
    assert full[:40] == keys(texts[:40])
    assert full[:40] == [keys([t])[0] for t in texts[:40]]


def test_any_split_of_a_table_gives_the_same_classes(spark, documents):
    rng, texts = random.Random(21), {}
    for f in range(40):
        base = [f"f{f}w{rng.randrange(300)}" for _ in range(rng.choice([40, 100, 400]))]
        texts[len(texts)] = " ".join(base)
        texts[1000 + f] = edited(base, rng, 1 if len(base) < 100 else 2)
    want = components(texts)
    rows = [(i, t, "s") for i, t in texts.items()]
    originals, copies = documents([r for r in rows if r[0] < 1000]), documents([r for r in rows if r[0] >= 1000])
    layouts = [documents(rows).coalesce(1), documents(rows).repartition(23), originals.coalesce(1).union(copies.repartition(17))]
    got = [{r.doc_id: r.class_id for r in N.near_duplicates(x).collect()} for x in layouts]
    assert got[0] == got[1] == got[2]
    assert np.mean([got[0][i] == want[i] for i in want]) >= 0.99


def test_unsettled_labels_raise(spark):
    from quillspark.llm._components import components as labels

    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.comp for r in labels(chain).collect()} == {0}
    try:
        labels(chain, max_rounds=1)
    except RuntimeError:
        return
    raise AssertionError
