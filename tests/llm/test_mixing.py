import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import mixing
from quillspark.llm.mixing import capped, mix, op2_query, sainte_lague, targets


def by_quotients(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats if sum(votes) > 0 else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 80))
@settings(max_examples=150, deadline=None)
def test_apportionment(votes, seats):
    assert sainte_lague([float(v) for v in votes], seats) == by_quotients(votes, seats)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=10))
@settings(max_examples=80, deadline=None)
def test_targets(sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    t = targets(sizes, w)
    assert all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes)) and sum(t) == pytest.approx(sum(sizes))
    free = [x / y for x, s, y in zip(t, sizes, w) if s and x < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_mix(spark, documents, write):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 400), rng.choice(["b", "a", "hot", "hot", "hot", None])) for i in range(3000)]
    path = write(documents=documents(rows))
    got = op2_query(spark, path).collect()
    assert len(got) == len(rows)
    sizes = {i: len(re.findall(r"\S+", t)) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    source = {i: s for i, _, s in rows}
    total = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in names}
    goal = dict(zip(names, targets([total[s] for s in names], [5, 2, 1, 5])))
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 16 * 40 for s in names)
    again = mix(spark.read.parquet(f"{path}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_edges(edges, documents):
    got = mix(edges).collect()
    assert len(got) == 10 and all(r.taken <= 3 * r["size"] for r in got)
    assert mix(documents([]).where("false")).count() == 0
    assert [r.taken for r in mix(documents([(1, None, None), (2, "", "a")])).collect()] == [0, 0]


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 80))
@settings(max_examples=150, deadline=None)
def test_what_full_shards_leave_is_dealt_on(parties, seats):
    votes, most = [float(v) for v, _ in parties], [m if v else 0 for v, m in parties]
    got = capped(votes, seats, most)
    assert all(0 <= g <= m for g, m in zip(got, most)) and sum(got) == min(seats, sum(most))
    if seats <= sum(most) and all(g < m for g, m in zip(got, most)):
        assert got == sainte_lague(votes, seats)


def test_many_sources_and_repeats(spark, documents, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(40) if i % 5 else None, "w " * rng.randrange(0, 90), f"s{rng.randrange(30):02}") for i in range(900)]
    few = sorted(map(tuple, mix(documents(rows)).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mix(documents(rows).repartition(5)).collect()), key=str) == few
    assert all(t <= 3 * size for _, size, _, _, t in few)


def test_taken_by_document(documents):
    """One shard a source: its stream in the seeded order, passes and a rest, held against plain Python."""
    rows = [(i, "w " * (i % 23), "ab"[i % 2]) for i in range(200)]
    got = mix(documents(rows)).collect()
    for s, k in (("a", 0), ("b", 1)):
        own = [r for r in got if r.doc_id % 2 == k]
        quota, words = sum(r.taken for r in own), sum(r["size"] for r in own)
        assert abs(quota - own[0].target) <= 16
        full, rest = divmod(quota, words)
        extra = [(r.taken - full * r["size"], r["size"]) for r in own]
        assert sum(x for x, _ in extra) == rest and all(0 <= x <= size for x, size in extra)
        assert sum(0 < x < size for x, size in extra) <= 1  # the stream is cut in one document
