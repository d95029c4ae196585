"""Operators against a few lines of plain Python."""

import difflib
import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.functions import text as X
from quillspark.operators import alignment, choice, enrich, evaluate, fusion, generate, intervals, learn, lineage, planning, pool
from quillspark.plans.evidence import candidates


def candidate(**x):
    base = dict(group_id=1, candidate_id="a", text="t", avg_logprob=None, cumulative_logprob=None, acoustic=None, mora=None, lexical=None, preservation=None, cross_model=None, teacher=None, sequence_score=None, rank=None, hypothesis_count=None, beam_confidence=None, token_count=1, degenerate=False, second_ear=False, source="s", domain="d")
    return base | x


SCHEMA = "group_id long, candidate_id string, text string, avg_logprob double, cumulative_logprob double, acoustic double, mora double, lexical double, preservation double, cross_model double, teacher double, sequence_score double, rank int, hypothesis_count int, beam_confidence double, token_count int, degenerate boolean, second_ear boolean, source string, domain string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_spoken_candidate_wins(spark):
    rows = [candidate(candidate_id=i, text=i, acoustic=a, mora=m, lexical=l, preservation=p, teacher=t) for i, a, m, l, p, t in (("spoken", 0.91, 0.89, 0.38, 0.96, 0.08), ("clean", 0.62, 0.58, 0.95, 0.42, 0.92), ("wrong-entity", 0.31, 0.22, 0.83, 0.21, 0.71))]
    top = fusion.fuse(frame(spark, rows)).where("position = 1").first()
    assert top.candidate_id == "spoken" and top.honeytrap_penalty == 0
    assert choice.cascade(frame(spark, rows)).first().selected_text == "spoken"


def test_mass_adds_up_only_within_a_domain(spark):
    rows = [candidate(candidate_id="a", avg_logprob=-1.0, domain="x"), candidate(candidate_id="b", avg_logprob=-1.0, domain="x"), candidate(candidate_id="c", avg_logprob=-1.0, domain="y", source="z")]
    r = pool.pool_candidates(frame(spark, rows)).first()
    assert r.cumulative_logprob == pytest.approx(-2 + math.log(2)) and r.path_count == 3 and r.cross_model == pytest.approx(0.62) and list(r.domains) == ["x", "y"]


def test_pool_of_paths(spark):
    paths = spark.createDataFrame([(1, "a1", "P", -1.0, None, "s"), (1, "a2", "P", -2.0, None, "s"), (1, "b1", "Q", -1.1, None, "s"), (1, "c1", "R", -1.6, None, "t")], "group_id long, path_id string, text string, logprob double, rank int, source string")
    d = pool.pool_diagnostics(paths, pool.pool_paths(paths)).first()
    assert (d.path_count, d.surface_count, d.unique_ratio, d.source_count) == (4, 3, 0.75, 2)
    best = pool.top_k(pool.pool_paths(paths), 1).first()
    assert best.pool_key == "P" and best.path_mass_bonus == pytest.approx(math.log(1 + math.exp(-1)))


def test_order_of_rows_does_not_matter(spark, sf):
    a = choice.cascade(candidates(spark, sf)).select("group_id", "selected_id", "k", "agree")
    b = choice.cascade(candidates(spark, sf).orderBy(F.rand(3)).repartition(3)).select("group_id", "selected_id", "k", "agree")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_null_evidence_is_not_zero(spark):
    rows = [candidate(candidate_id="x", text="x", acoustic=0.5, preservation=None), candidate(candidate_id="y", text="y", acoustic=0.5, preservation=0.9)]
    got = {r.candidate_id: r for r in fusion.fuse(frame(spark, rows)).collect()}
    assert got["x"].missing_penalty > got["y"].missing_penalty and got["x"].preservation is None


def test_corpus_and_mean_can_disagree(spark):
    base, new = [("short", 1, 1), ("long", 100, 0)], [("short", 1, 0), ("long", 100, 2)]
    make = lambda rows: spark.createDataFrame([("k", u, e, e / u) for _, u, e in rows], "k string, units int, edits int, rate double")
    a, b = evaluate.corpus_and_mean(make(base), ["k"]).first(), evaluate.corpus_and_mean(make(new), ["k"]).first()
    assert b.corpus_rate - a.corpus_rate == pytest.approx(1 / 101) and b.utterance_mean - a.utterance_mean == pytest.approx(-0.49)


def test_error_rate_of_empty_references(spark):
    r = spark.createDataFrame([("", ""), ("", "x"), ("ab", "")], "r string, h string").select(evaluate.cer(F.col("r"), F.col("h")).alias("c")).collect()
    assert [x.c for x in r] == [0.0, None, 1.0]


def test_exact_cer(spark):
    r = spark.createDataFrame([("(F あの) 今日", "あの今日"), ("(?) 今日", "今日"), ("[Mask] x", "x")], "a string, h string").select(evaluate.exact_cer(F.col("a"), F.col("h")).alias("c")).collect()
    assert [x.c for x in r] == [0.0, None, None]


words = st.lists(st.sampled_from("abcキ"), max_size=6)


@given(st.lists(st.tuples(words, words), min_size=1, max_size=5))
@settings(max_examples=8, deadline=None)
def test_array_distance(spark, pairs):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1]

    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(X.array_edit_distance(F.col("a"), F.col("b")).alias("d"), X.multiset_overlap(F.col("a"), F.col("b")).alias("o"))
    assert [(r.d, r.o) for r in df.collect()] == [(lev(a, b), sum(min(a.count(c), b.count(c)) for c in set(a))) for a, b in pairs]


def test_text_kernels(spark):
    assert K.lenient_key("Ａ、 ｂ！") == "Ab" and K.surface_key(" é ") == "é" and K.folded("ｱ ｲ") == "アイ"
    assert K.morae("シャッター") == ["シャ", "ッ", "タ", "ー"] and K.morae("シ・ャ") == ["シ", "ャ"] and K.morae("漢字") == []
    assert K.numerals("二十三人と三人、千九百八十四年") == "23人と三人、1984年"
    assert K.numerals("二十万と一〇二", exclude=("二十万",)) == "二十万と102" and K.numerals("四十", force={"四十": "よんじゅう"}) == "よんじゅう" and K.numerals("三千二百", language="en") == "三千二百"
    assert K.critical_units("¥100を3/4に払わない ABC") == ["currency:¥100", "number:100", "date-time:3/4", "number:3/4", "negation:ない", "entity:ABC"]
    assert K.join_fragments(["今日は雨", "は雨です。", "。次"]) == "今日は雨です。次" and K.join_fragments(["abc", "def"]) == "abc def"
    assert K.compression_ratio("") == 1.0 and K.compression_ratio("ab" * 300) > 10
    assert K.longest_common_substring("xabcy", "zabcw") == 3
    with pytest.raises(ValueError):
        K.pseudonym("x", b"short")
    K.register(spark)
    assert spark.sql("SELECT nfkc('ｱ') a, lenient_key('x y') b").first() == ("ア", "xy")


def test_lattice(spark):
    rows = spark.createDataFrame([(1, "a", "今日は東京に行く", 0.6), (1, "b", "今日は東京へ行く", 0.3), (1, "c", "今日は京都に行く", 0.1)], "group_id long, candidate_id string, text string, posterior double")
    got = alignment.lattice(rows).collect()
    pivot = list("今日は東京に行く")
    marks = alignment.difference_islands(pivot, [list("今日は東京へ行く"), list("今日は京都に行く")])
    assert [(r.start, r.end) for r in got] == marks and got[0].pivot in "今日は東京に行く"
    ops = difflib.SequenceMatcher(a=pivot, b=list("今日は東京へ行く"), autojunk=False).get_opcodes()
    assert ["".join(alignment.projected(ops, list("今日は東京へ行く"), 5, 6))] == ["へ"]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.lists(st.integers(0, 3), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_warp(a, b):
    d = np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0)))

    def best(i, j):
        if i == 0 and j == 0:
            return d[a[0], b[0]], 1
        return min((c + d[a[i], b[j]], n + 1) for c, n in (best(x, y) for x, y in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if x >= 0 and y >= 0))

    assert alignment.warp(d[np.ix_(a, b)]) == best(len(a) - 1, len(b) - 1)


def test_ctc():
    p = np.random.default_rng(1).dirichlet(np.ones(3), 5)
    total = 0.0
    for path in itertools.product(range(3), repeat=5):
        if [k for k, _ in itertools.groupby(path) if k] == [1, 2]:
            total += math.prod(p[t, s] for t, s in enumerate(path))
    assert alignment.ctc_log_likelihood(p, [1, 2]) == pytest.approx(math.log(total))
    assert alignment.ctc_log_likelihood(p, []) == pytest.approx(np.log(p[:, 0]).sum())


def test_best_window_and_beam():
    assert alignment.best_window("abc", "xxabcxx") == (0, 2, 5)
    spans = [[("a", 1.0), ("b", 1.0)], [("c", 0.5), ("d", 2.0)]]
    assert alignment.beam(spans, lambda x, y: 0.0, 64)[0] == (3.0, ("a", "d"))
    assert alignment.beam(spans, lambda x, y: 5.0 if (x, y) == ("b", "c") else 0.0, 64)[0] == (6.5, ("b", "c"))


def test_leaks_cycles_and_rights(spark):
    rows = [(1, "train", "A", []), (2, "test", "A", [1]), (3, "train", "B", [4]), (4, "train", "B", [5]), (5, "train", None, [3]), (6, "test", "C", [99])]
    rec = spark.createDataFrame(rows, "sample_id long, split string, speaker_id string, parent_sample_ids array<long>")
    assert {(r.kind, r.value) for r in lineage.leakage(rec).collect()} == {("speaker-id", "A"), ("parent-sample-id", "1")}
    assert [r.parent_id for r in lineage.missing_parents(rec).collect()] == [99]
    assert {r.sample_id for r in lineage.cyclic_samples(rec).collect()} == {3, 4, 5}
    rights = spark.createDataFrame([("x", "allow"), ("y", "review")], "asset_id string, training string")
    some = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "sample_id long, rights_asset_id string")
    bad = lineage.denied(some, rights, "training")
    assert {(r.sample_id, r.state) for r in bad.collect()} == {(2, "review"), (3, "unknown")}
    with pytest.raises(PermissionError):
        lineage.require(bad, "rights")


def test_decoded_runs_keep_separated_repeats(spark):
    frames = [("a", 0.9), ("a", 0.8), ("_", 0.7), ("a", 0.6), ("b", 0.5)]
    rows = spark.createDataFrame([(1, t, s, p) for t, (s, p) in enumerate(frames)] + [(1, t, "z", 0.01) for t in range(5)], "seq long, frame long, symbol string, p double")
    got = sorted(map(tuple, intervals.decoded_runs(rows, "_").select("symbol", "start", "end", "least").collect()), key=lambda r: r[1])
    assert got == [("a", 0, 2, 0.8), ("a", 3, 4, 0.6), ("b", 4, 5, 0.5)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, -0.2, -0.1, 1.0, 0.0, 1.0), (9, -0.2, -0.1, 1.0, 0.0, 1.0)], "groups long, lower double, upper double, better double, critical_delta double, latency_ratio double")
    assert [r.passed for r in evaluate.claim_gate(rows).orderBy("groups").collect()] == [False, True]
    names = [*evaluate.IDENTITIES, "calibration", *evaluate.REGRESSIONS, *evaluate.RATIOS, "replay_rate"]
    base = {n: "x" for n in [*evaluate.IDENTITIES, "calibration"]} | {n: 1.0 for n in [*evaluate.REGRESSIONS, *evaluate.RATIOS, "replay_rate"]}
    bad = base | {"aurc": 1.5, "memory_mb": 2.0, "top1_accuracy": 0.9, "hardware": "y", "calibration": None}
    row = lambda c: tuple(base[n] for n in names) + tuple(c[n] for n in names)
    kind = ", ".join(f"{p}_{n} {'string' if isinstance(base[n], str) else 'double'}" for p in "bc" for n in names)
    got = evaluate.deployment_gate(spark.createDataFrame([row(base), row(bad)], kind)).collect()
    assert got[0].accepted and got[1].reasons == ["runtime-hardware-mismatch", "missing-calibration-digest", "top1-accuracy-regression", "aurc-regression", "memory-regression"]


def test_bootstrap(spark):
    rows = spark.createDataFrame([("a", 15, 4, 2), ("b", 40, 1, 2)], "group_id string, reference_units long, baseline_errors long, candidate_errors long")
    r = evaluate.paired_bootstrap(rows, iterations=200, seed=17).first()
    rng, deltas = random.Random(17), []
    for _ in range(200):
        i = [rng.randrange(2) for _ in range(2)]
        u, d = [(15, -2), (40, 1)], 0
        deltas.append(sum(u[k][1] for k in i) / sum(u[k][0] for k in i) + d)
    assert r.delta == pytest.approx(-1 / 55) and r.better == sum(x < 0 for x in deltas) / 200
    with pytest.raises(Exception, match="no counterpart"):
        evaluate.paired_cohort(spark.createDataFrame([(1, 1, "x", 1.0)], "sample_id long, group_id long, system string, value double"), "x", "y").collect()


def test_learning(spark):
    rng = random.Random(1)
    rows = []
    for g in range(60):
        for i in range(4):
            x = rng.random()
            rows.append((g, str(i), x, rng.random(), 1 - x))
    df = spark.createDataFrame(rows, "group_id long, candidate_id string, x double, z double, loss double")
    for ranker in (learn.train_pairwise(df, ["x", "z"], epochs=10), learn.train_listwise(df, ["x", "z"], epochs=40, signs={"z": 1})):
        assert ranker.weights["x"] > abs(ranker.weights["z"]) and ranker.history[-1] < ranker.history[0]
        assert learn.evaluate_ranker(df.withColumn("s", ranker.column()), "s").first().accuracy > 0.9
    w = learn.ridge(df.withColumn("t", 2 * F.col("x") - F.col("z") + 3), ["x", "z"], "t", penalty=1e-9)
    assert w[""] == pytest.approx(3, abs=1e-4) and w["x"] == pytest.approx(2, abs=1e-4)
    judged = spark.createDataFrame([(i / 100, rng.random() < 1 / (1 + math.exp(-(i / 10 - 5)))) for i in range(100)] * 5, "score double, correct boolean")
    a, b = learn.platt(judged)
    assert a > 3
    blocks = learn.isotonic(judged)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(blocks, blocks[1:]))
    step = lambda v: next((p for x, p in blocks if x >= v), blocks[-1][1])
    probe = [0.0, 0.33, 0.7, 2.0]
    got = spark.createDataFrame([(v,) for v in probe], "v double").select(learn.isotonic_column(F.col("v"), blocks).alias("p")).collect()
    assert [r.p for r in got] == [step(v) for v in probe]
    del b


def test_planning(spark):
    rows = [(1, f"{i}:{k}", str(i), u, 0.5, g, c) for i, k, u, g, c in ((1, "a", 0.9, 0.5, 100), (1, "b", 0.8, 0.4, 100), (1, "c", 0.7, 0.4, 100), (2, "a", 0.6, 0.3, 5000), (3, "a", 0.00001, 0.3, 10))]
    df = spark.createDataFrame(rows, "group_id long, action_id string, island string, utility double, criticality double, gain double, cost_ms long")
    got = {r.action_id: r.selected for r in planning.greedy(df, budget_ms=4000).collect()}
    assert got == {"1:a": True, "1:b": True, "1:c": False, "2:a": False, "3:a": False}
    kinds = df.withColumn("kind", F.when(F.col("island") == "1", "x").otherwise("y"))
    state = planning.update_router(spark.createDataFrame([("x", 1, 0.5)], "kind string, selections long, reward_sum double"), spark.createDataFrame([("x", 0.1), ("y", 1.0), ("y", float("nan")), ("z", None)], "kind string, reward double"))
    assert {(r.kind, r.selections, r.reward_sum) for r in state.collect()} == {("x", 2, 0.6), ("y", 1, 1.0)}
    base = {r.action_id: r.base for r in planning.route_scores(kinds, state).collect()}
    assert base["1:a"] == pytest.approx(0.9 + 0.18 * (0.5 - 2 / 3) + 0.12 * 0.3 + 0.3 * 0.5) and base["2:a"] == pytest.approx(0.6 + 0.18 * (0.5 - 1 / 3) + 0.12 + 0.15)
    routed = sorted(planning.routed(kinds, state, budget_ms=6000).collect(), key=lambda r: r.step)
    assert [(r.action_id, r.selected, r.used_ms) for r in routed] == [("1:a", True, 100), ("2:a", True, 5100), ("1:b", True, 5200), ("3:a", True, 5210), ("1:c", False, 5210)]
    dep = spark.createDataFrame([(1, "x", 1.0, 10, ["y"], ""), (1, "y", 0.1, 10, [], ""), (1, "p", 0.5, 10, [], "e"), (1, "q", 0.4, 10, [], "e")], "group_id long, action_id string, gain double, cost_ms long, needs array<string>, exclusive string")
    assert {r.action_id for r in planning.with_dependencies(dep, budget_ms=100, most=9).collect() if r.selected} == {"x", "y", "p"}


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, "a", "x", True), (1, "b", "y", False), (2, "c", "z", True)], "group_id long, candidate_id string, text string, degenerate boolean")
    assert {r.candidate_id for r in enrich.loop_guard(rows).collect()} == {"b", "c"}
    shares = spark.createDataFrame([(1, "t1", 10.0), (1, "t2", 1.0), (1, "t3", 1.0)], "group_id long, teacher string, weight double")
    got = {r.teacher: r.share for r in enrich.capped_shares(shares).collect()}
    assert got["t1"] == pytest.approx(0.6) and sum(got.values()) == pytest.approx(1)
    three = spark.createDataFrame([(1, "q", "Ａ!"), (1, "w", "A"), (1, "k", "a".upper())], "group_id long, engine string, text string")
    folded = three.withColumn("text", K.nfkc_column("text"))
    assert enrich.frozen_consensus(folded, primary="q", others=("k",), fallback="w").first().engine == "q"
    assert unicodedata.normalize("NFKC", "Ａ") == "A"


def test_hard_negatives(spark):
    rows = spark.createDataFrame([(1, "会議は3時に始まりません"), (2, None), (3, ""), (4, "ない"), (5, "plain")], "id long, text string")
    got = {i: [] for i in range(1, 6)}
    for r in generate.hard_negatives(rows).collect():
        got[r.id].append((r.kind, r.text, r.severity, r.start, r.end))
    assert got[1] == sorted(got[1], key=lambda x: (-x[2], x[0], x[1])) and len({x[1] for x in got[1]}) == len(got[1]) <= 12
    assert ("number", "会議は4時に始まりません", 1.0, 3, 4) in got[1] and ("negation-flip", "会議は3時に始まります", 1.0, 9, 12) in got[1] and ("particle", "会議が3時に始まりません", 0.45, 2, 3) in got[1]
    assert ("number", "会議は3時に始まりません", 1.0, 3, 4) not in got[1] and ("phonetic-neighbour", "会議ば3時に始まりません", 0.35, 2, 3) in got[1]
    assert got[4] == [("negation-flip", "ある", 1.0, 0, 2)] and not got[2] and not got[3] and not got[5]
    made = generate.ranker_examples(rows).where("group_id = 1").orderBy("rank").collect()
    assert made[0].candidate_id == "reference" and made[0].acoustic == 0.92 and [r["rank"] for r in made] == list(range(1, len(made) + 1)) and made[1].candidate_id == "negative-002"


def test_gates_and_teachers(spark):
    from quillspark.operators import distil, gates

    judged = spark.createDataFrame([(1, t, c, s, "probability", 1.0, False) for t, c, s in (("a", "x", 0.9), ("a", "y", 0.1), ("b", "x", 0.8), ("b", "y", 0.2))] + [(2, "a", "x", 1.0, "logit", 1.0, True)], "group_id long, teacher string, candidate_id string, score double, kind string, reliability double, abstained boolean")
    preference, groups = distil.teacher_consensus(judged)
    p = {r.candidate_id: r.preference for r in preference.collect()}
    g = {r.group_id: r for r in groups.collect()}
    assert p["x"] > 0.8 and sum(p.values()) == pytest.approx(1) and g[1].usable and g[2].reasons == ["insufficient-active-teachers", "all-teachers-abstained"]
    rows = spark.createDataFrame([(1, 1.0, 0.0), (1, 0.0, 1.0)], "group_id long, teacher double, student double").withColumn("candidate_id", F.col("teacher").cast("string"))
    assert distil.decoupled_top_k(rows, k=1).first().loss > 0
    policies = gates.default_policies(spark)
    assert policies.count() == 6
    known = policies.withColumns({"passed": F.col("candidate_count") < 9, "mean_cost": F.col("candidate_count") * 100.0, "upper": F.lit(0.05)})
    states = spark.createDataFrame([(1, 4, 10_000.0), (2, 1, 1.0)], "state_id long, available int, budget double")
    assert {r.state_id: r.policy_id for r in gates.select_policy(known, states).collect()} == {1: "k1-cheap", 2: "k16-verified-fallback"}


def test_pairwise_alignment(spark):
    from quillspark.operators import distil

    r = spark.createDataFrame([(-2.0, -8.0, 4, 4, None, None)], "chosen_logprob double, rejected_logprob double, chosen_length int, rejected_length int, reference_chosen_logprob double, reference_rejected_logprob double")
    assert distil.pairwise_alignment(r).first().loss == pytest.approx(math.log(1 + math.exp(-1.5)))


def test_japanese():
    from quillspark.functions import japanese as J

    assert [u.phones for u in J.kana_to_phones("きゃっかー")] == [("ky", "a"), ("cl",), ("k", "a"), ("a",)]
    with pytest.raises(ValueError):
        J.kana_to_phones("漢")
    with pytest.raises(ValueError):
        J.kana_to_phones("ー")
    units = J.phones_to_units(["k", "a", "a", "N", "cl", "pau", "s", "U", "x"])
    assert [u.kind for u in units] == ["regular", "regular", "moraic-nasal", "geminate", "pause", "regular", "unresolved"] and units[1].maybe_long and units[5].devoiced
    assert sum((u.phones for u in units), ()) == ("k", "a", "a", "N", "cl", "pau", "s", "U", "x")
    assert J.timed_morae([("シ", 0, 1, 0.9), ("ャ", 1, 2, 0.5), ("、", 2, 3, None), ("ャ", 3, 4, None)]) == [("シャ", 0, 2, 0.5), ("ャ", 3, 4, None)]
    assert J.normalise("今日 は !!!!\n\n\n\nはい。。。。") == "今日 は！！\n\nはい。。" and J.reading("かな、カナ") == "カナ、カナ" and J.reading("漢") is None
    assert J.join_timed([(0, 10, "今日は雨"), (5, 15, "は雨だ"), (20, 30, "だ。")]) == "今日は雨だだ。"
    with pytest.raises(ValueError):
        J.join_timed([(5, 6, "a"), (0, 1, "b")])
    assert J.tokens("東京タワー Big-5 3.5", "subword") == ["東京", "タワ", "ワー", "big-5", "3.5"] and J.tokens("漢 a", "mora") == ["surface:漢", "surface:a"]
    assert J.filler_score("(F えーと) 今日", "えーと今日") == (1.0, 1.0, 1.0) and J.filler_score("x", "y") is None
    assert J.unsupported_share("abc", "abd", []) == 1.0 and J.unsupported_share("abc", "abd", [(2, 3)]) == 0.0 and J.unsupported_share("a", "a", []) == 0.0


def test_deliberation(spark):
    from quillspark.operators import deliberate as D

    kind = "doc long, span int, arc string, retained boolean, generated boolean, independent boolean, eligible boolean, score double, factor double, audio double"
    rows = [
        (1, 0, "a0", True, False, True, True, 0.1, 1.0, 0.5), (1, 0, "a1", False, False, True, True, 0.9, 1.0, 0.45), (1, 0, "a2", False, False, True, True, 5.0, 1.0, 0.1),
        (1, 1, "b0", True, False, True, True, 0.2, 1.0, 0.5), (1, 1, "b1", False, True, False, True, 9.0, 1.0, 0.5), (2, 0, "c0", True, False, True, True, 0.0, 1.0, None),
    ]
    arcs = spark.createDataFrame(rows, kind)
    got = {r.doc: r for r in D.decode(arcs).collect()}
    assert got[1].path == ["a1", "b0"] and got[1].status == "accepted" and got[1].reasons == ["changed-span:0"] and got[2].reasons == ["single-surviving-path"]
    context = spark.createDataFrame([(1, "a0>b0", 2.0)], "doc long, path string, value double")
    assert {r.doc: r.path for r in D.decode(arcs, context=context).collect()}[1] == ["a0", "b0"]
    free = {r.doc: r for r in D.decode(arcs, D.Policy(independent_audio=False)).collect()}[1]
    assert free.path == ["a1", "b1"] and free.status == "provisional"
    mix = spark.createDataFrame([(1, "m", 1.0, 0.0, "x", 1.0), (1, "n", 0.5, 0.0, "x", 0.0), (1, "o", 0.01, 0.0, "x", 9.0)], "group_id long, branch string, reliability double, cost double, candidate_id string, score double")
    assert D.residual_mix(mix).first().score == pytest.approx(2 / 3)


def test_features_and_directional_loss(spark):
    from quillspark.operators import features

    r = features.surface_features(features.candidate_features(pool.pool_candidates(frame(spark, [candidate(text="会議は3時ない", acoustic=0.5, rank=1, hypothesis_count=4)])))).first()
    assert (r.f_relative_rank, r.g_number, r.g_negation, r.g_entity, r.g_missing) == (1.0, 1.0, 1.0, 0.0, pytest.approx(0.8))
    pair = spark.createDataFrame([("3時です", "時です"), ("時です", "3時です"), ("", "")], "a string, b string").select(*[v.alias(k) for k, v in features.directional_loss(F.col("a"), F.col("b")).items()])
    x, y, z = pair.collect()
    assert x.number == 1.0 and x.unsupported_insertion == pytest.approx(0.25) and y.unsupported_insertion == 0 and y.number == 1.0 and z.loss == 0
    m = spark.createDataFrame([("¥100払う。", "¥200払う")], "r string, o string").select(*[v.alias(k) for k, v in features.transcript_measures(F.col("r"), F.col("o")).items()]).first()
    assert m.currency == 1.0 and m.negation == 0.0 and m.punctuation_f1 == 0.0


def test_fusion_weights(spark):
    rng = random.Random(8)
    rows = [(g, str(i), x, rng.random(), 1 - x) for g in range(50) for i in range(4) for x in [rng.random()]]
    df = learn.target_distribution(spark.createDataFrame(rows, "group_id long, candidate_id string, acoustic double, lexical double, loss double"))
    assert df.groupBy("group_id").agg(F.sum("target").alias("t")).where("abs(t - 1) > 1e-9").count() == 0
    w = learn.train_fusion(df.drop("loss"), {"acoustic": 0.5, "lexical": 0.5}, ("acoustic",), epochs=60)
    assert sum(w.values()) == pytest.approx(1) and w["acoustic"] >= 0.72 - 1e-9
    assert list(learn.on_simplex(np.array([2.0, 0.0]))) == [1.0, 0.0]


def test_document_beam(spark):
    from quillspark.operators import deliberate as D

    unit = "array<struct<start:bigint,end:bigint,text:string>>"
    kind = f"doc long, window int, option string, retained boolean, changed boolean, generated boolean, start long, end long, delta double, audio double, units {unit}"
    say = lambda *xs: [dict(start=a, end=b, text=t) for a, b, t in xs]
    rows = [
        (1, 0, "k0", True, False, False, 0, 100, 0.0, 0.5, say((0, 80, "head"), (80, 100, "shared"))), (1, 0, "x0", False, True, False, 0, 100, 0.4, 0.5, say((0, 80, "head"), (80, 100, "zzzzzz"))),
        (1, 1, "k1", True, False, False, 80, 180, 0.0, 0.5, say((80, 100, "shared"), (100, 180, "tail"))), (1, 1, "x1", False, True, False, 80, 180, 0.3, 0.5, say((80, 100, "shared"), (100, 180, "other"))),
        (1, 1, "y1", False, True, False, 80, 180, 9.0, 0.0, say((80, 100, "shared"))),
    ]
    got = D.decode_document(spark.createDataFrame(rows, kind)).first()
    # x0 no longer agrees with its neighbour where they overlap, y1 lost its audio support.
    assert got.path == ["k0", "x1"] and got.changed == 1 and got.status == "accepted" and got.score == pytest.approx(100 / 200 * 0.3 - 0.02)
    assert D.overlap_similarity(say((0, 5, "ab")), say((0, 5, "a b!")), 0, 5, 2) == 1.0 and D.overlap_similarity(say((0, 5, "a")), say((0, 5, "a")), 0, 5, 2) is None
