"""What reviews found: odd inputs and larger tables, each against the query's SQL or plain Python."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import context, lineage, planning
from quillspark.plans import catalog

SQL = catalog.oracle_sql()


def agree(spark, folder, name, **tables):
    """The query's rows, sorted, which must be those of its SQL over the same files."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    got = order(catalog.queries()[name](spark, str(folder)).select(columns).collect())
    assert got == order(want.fetchall())
    return got


def test_upsert_has_every_order(spark, tmp_path):
    day = lambda n: datetime.datetime(1999, 1, 1, 12) + datetime.timedelta(days=n)
    rows = [(2, 1, day(0)), (-3, 1, day(9)), (None, 2, day(5)), (4, 2, day(1)), (5, None, day(2)), (6, 701, day(9)), (8, 3, None), (1, 4, day(-20_000))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert len(agree(spark, tmp_path, "cache_upsert", orders=spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))) == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_attribution_with_spans_of_no_length(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    # user 1: 200 s under one span with a point within it and one at its start; user 2: a point alone; user 3: a point in a gap; user 4: a span that ends before it starts
    rows = [(1, at(0), 1, 1.0), (2, at(50), 1, 0.0), (3, at(0), 1, 0.0), (4, at(0), 2, 0.0), (5, at(0), 3, 1.0), (6, at(300), 3, 0.0), (7, at(400), 3, 1.0), (8, at(0), 4, 1.0), (9, at(100), 4, -0.25), (10, at(0), 4, None)]
    assert (1, 2, 100_000.0) in agree(spark, tmp_path, "coverage_attribution", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double"))


def test_routing_tries_a_repeated_id_once(spark, tmp_path):
    lines = [(1, 10 + n, 5, n, 2.0, 10.0 * n, 0.01 * n, 0.02, "ANR"[n % 3]) for n in range(1, 8)]
    rows = [*lines, lines[2], lines[6], (1, 13, 5, 3, 9.0, 30.0, 0.03, 0.02, "A"), (2, 1, 1, 1, 1.0, 1.0, 0.1, 0.0, "R")]
    got = agree(spark, tmp_path, "routed_plan", lineitem=spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"))
    assert len(got) == 8


def test_catalogue_scores_texts_once(spark, tmp_path, monkeypatch):
    """More entries of a surface than a query returns, equal query texts, entries with two surfaces that score the same."""
    rows = [(i, f"Brand#{i % 3}", ("LARGE", "SMALL", "Brand#1")[i // 3 % 3], i * 7 % 5) for i in range(300)] + [(350, "Brand#2", "SMALL", 1)]
    scored, plain = spark.sparkContext.accumulator(0), context.phrase_similarity

    def counted(query, phrase, *, phonetic=False):
        seen = F.udf(lambda x: scored.add(1) or x, "double").asNondeterministic()
        return plain(query, phrase, phonetic=True) if phonetic else seen(plain(query, phrase))

    monkeypatch.setattr(context, "phrase_similarity", counted)
    got = agree(spark, tmp_path, "catalog_dice_topk", part=spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int"))
    assert len(got) == 5 * 7 and 0 < scored.value < 1_000


def test_cycles_of_long_chains_and_rings(spark, tmp_path):
    """Rings and chains of 400, which took a round for each two nodes of a chain."""
    jobs = spark.sparkContext.statusTracker()
    rows = [(i, i % 4) for i in range(1_600)]
    spark.sparkContext.setJobGroup("long chains", "")
    try:
        got = agree(spark, tmp_path, "parent_cycles", supplier=spark.createDataFrame(rows, "s_suppkey long, s_nationkey int"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 800 and len(jobs.getJobIdsForGroup("long chains")) < 30


def test_cycles_against_reachability(spark):
    rng = random.Random(5)
    for n, m, bound in ((40, 45, 1_000), (40, 45, 5), (25, 60, 1_000), (1, 1, 1_000)):
        edges = {(f"s{rng.randrange(n)}", f"s{rng.randrange(n)}") for _ in range(m)}
        reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
        for _ in range(n):
            reach = {a: to | {c for b in to for c in reach.get(b, ())} for a, to in reach.items()}
        records = spark.createDataFrame([(f"s{i}", [b for a, b in sorted(edges) if a == f"s{i}"] + ["gone"]) for i in range(n)], "sample_id string, parent_sample_ids array<string>")
        assert sorted(r.sample_id for r in lineage.cyclic_samples(records, task_edges=bound).collect()) == sorted(a for a in reach if a in reach[a])


def test_routing_state_does_not_depend_on_order(spark):
    rng = random.Random(7)
    rewards = [("a", x) for x in (1e16, 1.0, -1e16, 3.0)] + [("b", rng.uniform(0, 0.1) * 10 ** rng.randint(-3, 3)) for _ in range(2000)] + [("c", 0.0), ("c", 5e-300), ("d", -1e300), ("e", None), ("f", float("nan"))]
    state = spark.createDataFrame([("a", 2, 0.5), ("z", 1, None), ("y", 1, float("inf"))], "kind string, selections long, reward_sum double")
    found = set()
    for parts in (1, 3):
        for _ in range(2):
            rng.shuffle(rewards)
            out = planning.update_router(state, spark.createDataFrame(rewards, "kind string, reward double").repartition(parts)).collect()
            found.add(tuple(sorted((r.kind, r.selections, r.reward_sum) for r in out)))
    (got,) = found
    b = [x for k, x in rewards if k == "b"]
    assert dict((k, (n, x)) for k, n, x in got if k != "b") == {"a": (6, 4.5), "c": (2, 5e-300), "d": (1, -1e300), "y": (1, float("inf")), "z": (1, 0.0)}
    assert [(n, x) for k, n, x in got if k == "b"] == [(2000, pytest.approx(math.fsum(b), rel=1e-15))]


def test_routing_costs_are_rounded_and_lines_without_order_left_out(spark, tmp_path):
    rows = [(1, 10 + n, 5, n, 2.0 + 0.004 * n, 10.0 * n, 0.01 * n, 0.02, "ANR"[n % 3]) for n in range(1, 8)] + [(None, 1, 1, 1, 1.0, 1.0, 0.1, 0.0, "R"), (2, 1, 1, 1, 0.005, 1.0, 0.1, 0.0, "N"), (3, 1, 1, 1, 0.015, 1.0, 0.1, 0.0, "N")]
    got = agree(spark, tmp_path, "routed_plan", lineitem=spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"))
    assert len(got) == 9
