"""Queries on Python kernels and iterative learning, most of which SQL can't express; tests hold those against plain Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.operators import alignment, evaluate, generate, learn, planning
from quillspark.plans.evidence import candidates, table
from quillspark.plans.measure_queries import L, R
from quillspark.streaming import sessions


def nfkc_keys(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", K.nfkc_column("t").alias("nfkc"), K.lenient_key_column("t").alias("lenient"), K.surface_key_column("t").alias("surface"))


def kana_morae(spark, sf):
    text = F.element_at(F.array(*[F.lit(x) for x in ("きょうはがっこうへいく", "シャッター", "ﾃﾞｰﾀ", "とうきょう", "テスト、テスト")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.alias("t")).select("p_partkey", K.morae_column("t").alias("morae"), K.katakana_column("t").alias("katakana"))


def itn_ja(spark, sf):
    text = F.concat(F.lit("第"), F.element_at(F.array(*[F.lit(x) for x in ("二十三", "百五", "三", "千九百八十四", "一〇二")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("回"))
    return table(spark, sf, "part").select("p_partkey", text.alias("t"), K.numerals_column(text).alias("written"))


def compression_ratios(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.compression_ratio_column(F.coalesce("text", F.lit(""))).alias("ratio"))


def critical_unit_spans(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", K.critical_units_column("text").alias("units"))


def lattice_islands(spark, sf):
    c = candidates(spark, sf).select("group_id", "candidate_id", F.concat("text", F.substring("candidate_id", 1, 8)).alias("text"), (1.0 / F.col("rank")).alias("posterior"))
    return alignment.lattice(c)


def dtw(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: (x["value"] % 10).cast("int")).alias("observed"))
    far = np.abs(np.subtract.outer(np.arange(10.0), np.arange(10.0)))
    return alignment.warped(e.withColumn("canonical", F.sort_array("observed")), far).select("user_id", "cost", F.col("steps").cast("long").alias("steps"), F.round("normalised", 7).alias("normalised"))


def ctc_forward(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("v"))
    rows = e.withColumn("frames", F.transform(F.expr("transform(sequence(0, size(v) div 8 - 1), t -> slice(v, t * 8 + 1, 8))"), lambda f: F.transform(f, lambda x: x / F.aggregate(f, F.lit(0.0), lambda a, b: a + b)))).withColumn("symbols", F.array(*[(F.col("vec_id") % k + 1).cast("int") for k in (2, 3, 4)]))
    return alignment.ctc_scores(rows).select("vec_id", F.round("log_likelihood", 6).alias("log_likelihood"), F.round("mean_frame", 6).alias("mean_frame"))


def beam_decode(spark, sf):
    li = table(spark, sf, "lineitem")
    return alignment.beam_decode(li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("span"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("arc"), F.col("l_discount").alias("score")), best=2).select("doc", F.col("position").cast("long").alias("position"), F.round("score", 7).alias("score"), F.array_join("path", "|").alias("path"))


def greedy_plan(spark, sf):
    return planning.greedy(_actions(spark, sf), budget_ms=9_000, most=4).select("group_id", "action_id", "selected", "used_ms", F.col("step").cast("long").alias("step"))


def routed_plan(spark, sf):
    """Kinds are return flags; what first lines brought is the state."""
    li = table(spark, sf, "lineitem")
    none = spark.createDataFrame([], "kind string, selections long, reward_sum double")
    state = planning.update_router(none, li.where("l_linenumber = 1").select(F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("reward")))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = li.where("l_orderkey is not null").select(
        F.col("l_orderkey").alias("group_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("action_id"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 3).cast("string").alias("island"),
        (F.col("l_discount") / (100 + F.col("l_quantity") * 20)).alias("utility"), F.col("l_tax").alias("criticality"), F.rint(100 + F.col("l_quantity") * 100).cast("long").alias("cost_ms"),
    )
    return planning.routed(rows, state, budget_ms=9_000, most=4).select("group_id", "action_id", "selected", "used_ms", F.col("step").cast("long").alias("step"), F.round("score", 6).alias("score"))


def _actions(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("group_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("action_id"), (F.col("l_partkey") % 3).cast("string").alias("island"),
        (F.col("l_discount") / (100 + F.col("l_quantity") * 20)).alias("utility"), F.col("l_tax").alias("criticality"), F.col("l_discount").alias("gain"), (100 + F.col("l_quantity") * 100).cast("long").alias("cost_ms"),
    )


def _counts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 200).alias("group_id"), (F.length("o_orderpriority") + 5).alias("reference_units"), (F.col("o_orderkey") % 4).alias("baseline_errors"), (F.col("o_orderkey") % 7 % 4).alias("candidate_errors"))


def bootstrap_mt(spark, sf):
    return evaluate.paired_bootstrap(_counts(spark, sf))


def bootstrap_poisson(spark, sf):
    return evaluate.poisson_bootstrap(_counts(spark, sf), iterations=100)


def _judged(spark, sf):
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(y, "doc_id").select("doc_id", (F.coalesce("n_chars", F.lit(0)) % 1000 / 1000.0).alias("score"), F.col("quality").alias("correct"))


def isotonic_pav(spark, sf):
    rows = _judged(spark, sf)
    return rows.select("doc_id", F.round(learn.isotonic_column(F.col("score"), learn.isotonic(rows)), 7).alias("probability"))


def platt_scaling(spark, sf):
    from quillspark.functions.scores import sigmoid

    rows = _judged(spark, sf)
    a, b = learn.platt(rows, tolerance=1e-14)
    return rows.select("doc_id", F.round(sigmoid(a * F.col("score") + b), 4).alias("probability"))


def _ranked(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("group_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"), (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), (F.col("l_tax") + F.col("l_quantity") / 100).alias("loss"))


def pairwise_ranker(spark, sf):
    rows = _ranked(spark, sf)
    ranker = learn.train_pairwise(rows, ["q", "d"])
    return learn.evaluate_ranker(rows.withColumn("ranker", ranker.column()), "ranker")


def listwise_ranker(spark, sf):
    rows = _ranked(spark, sf)
    ranker = learn.train_listwise(rows, ["q", "d"])
    return learn.evaluate_ranker(rows.withColumn("ranker", ranker.column()), "ranker")


_SPOKEN = ("学校へは行かないで3時にきゃくを待っています", "えーっと今日はできませんでした", "スーパーの前で7人", "んー、まあ", "しょくじがない", "")


def _corrupted(spark, sf):
    """Each document with a Japanese sentence before its whole text."""
    d = table(spark, sf, "documents")
    said = F.element_at(F.array(*[F.lit(x) for x in _SPOKEN]), (F.col("doc_id") % len(_SPOKEN) + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.concat(said, F.coalesce("text", F.lit(""))).alias("text"))


def hard_negatives(spark, sf):
    out = generate.hard_negatives(_corrupted(spark, sf))
    return out.select("id", "kind", "severity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def synthetic_examples(spark, sf):
    out = generate.ranker_examples(_corrupted(spark, sf))
    return out.select("group_id", "candidate_id", "kind", L("rank"), L("hypothesis_count"), R("acoustic"), R("mora"), R("preservation"), R("avg_logprob"))


def realtime_sessions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.expr("row_number() over (partition by user_id order by ts, event_id) - 1").alias("i"), F.col("event_type").isin("click", "view", "purchase").alias("speech"))
    return sessions.batch_events(e.select("session", (F.col("i") * 4000).cast("long").alias("start_sample"), F.lit(4000).alias("samples"), "speech"))


QUERIES = {f.__name__: f for f in (nfkc_keys, kana_morae, itn_ja, compression_ratios, critical_unit_spans, lattice_islands, dtw, ctc_forward, beam_decode, greedy_plan, routed_plan, bootstrap_mt, bootstrap_poisson, isotonic_pav, platt_scaling, pairwise_ranker, listwise_ranker, hard_negatives, synthetic_examples, realtime_sessions)}

_ACTIONS = "a AS (SELECT l_orderkey AS g, concat_ws('-', l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_partkey % 3 AS isl, l_returnflag AS kind, l_linenumber AS line, l_discount AS disc, l_discount / (100 + l_quantity * 20) AS u, l_tax AS crit, (100 + l_quantity * 100)::BIGINT AS cost FROM lineitem)"
_RULES = ", ".join(f"({i}, '{kind}', {severity}, '{old}', '{new}')" for i, (kind, severity, old, new) in enumerate((kind, severity, *rule) for kind, severity, rules in generate.RULES if kind not in ("number", "filler-delete") for rule in rules))
_FILL = [rules for kind, _, rules in generate.RULES if kind == "filler-delete"][0]
_SAID = ", ".join(f"'{x}'" for x in _SPOKEN)
_NEGATIVES = f"""d AS (SELECT doc_id AS id, [{_SAID}][doc_id % {len(_SPOKEN)} + 1] || coalesce(text, '') AS t FROM documents),
      rules(i, kind, severity, old, new) AS (VALUES {_RULES}),
      digit AS (SELECT id, t, instr(t, x) - 1 AS p, x::INTEGER AS v FROM (SELECT id, t, regexp_extract(t, '[0-9]') AS x FROM d) WHERE x <> ''),
      filler AS (SELECT id, t, instr(t, x) - 1 AS p, length(x) AS n FROM (SELECT id, t, regexp_extract(t, '{"|".join(_FILL)}') AS x FROM d) WHERE x <> ''),
      hits AS (SELECT id, i, kind, severity, substring(t, 1, instr(t, old) - 1) || new || substring(t, instr(t, old) + length(old)) AS x, instr(t, old) - 1 AS s, instr(t, old) - 1 + length(old) AS e, t FROM d, rules WHERE contains(t, old)
        UNION ALL SELECT id, 18.1 + k / 100, 'number', 1.0, substring(t, 1, p) || ((v + m + 10) % 10)::VARCHAR || substring(t, p + 2), p, p + 1, t FROM digit, (VALUES (1, 1), (2, -1), (3, 10)) ds(k, m)
        UNION ALL SELECT id, 18.2, 'filler-delete', 0.55, substring(t, 1, p) || substring(t, p + n + 1), p, p + n, t FROM filler),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY id, x ORDER BY i) AS nth FROM hits WHERE x <> t)"""

SQL = {
    "kana_morae": """SELECT p_partkey, [['キョ','ウ','ハ','ガ','ッ','コ','ウ','ヘ','イ','ク'], ['シャ','ッ','タ','ー'], ['デ','ー','タ'], ['ト','ウ','キョ','ウ'], ['テ','ス','ト','テ','ス','ト']][p_partkey % 5 + 1] AS morae,
      ['キョウハガッコウヘイク', 'シャッター', 'データ', 'トウキョウ', 'テスト、テスト'][p_partkey % 5 + 1] AS katakana FROM part""",
    "itn_ja": "SELECT p_partkey, '第' || ['二十三', '百五', '三', '千九百八十四', '一〇二'][p_partkey % 5 + 1] || '回' AS t, '第' || ['23', '105', '三', '1984', '102'][p_partkey % 5 + 1] || '回' AS written FROM part",
    "dtw": """WITH RECURSIVE u AS (SELECT user_id, list(trunc(value % 10)::INTEGER ORDER BY ts, event_id) AS o, list_sort(list(trunc(value % 10)::INTEGER)) AS c FROM events GROUP BY user_id),
      r(user_id, i, line) AS (SELECT user_id, 0, list_prepend({'t': 0.0::DOUBLE, 's': 0}, list_transform(o, lambda x: {'t': 'inf'::DOUBLE, 's': 1000000})) FROM u
        UNION ALL SELECT r.user_id, r.i + 1, list_reduce(range(1, len(u.o) + 1), lambda made, j: list_append(made, list_transform([list_sort([r.line[j], r.line[j + 1], made[j]])[1]], lambda b: {'t': b.t + abs(u.c[r.i + 1] - u.o[j]), 's': b.s + 1})[1]), [{'t': 'inf'::DOUBLE, 's': 1000000}]) FROM r JOIN u USING (user_id) WHERE r.i < len(u.c))
      SELECT user_id, line[-1].t AS cost, line[-1].s::BIGINT AS steps, round(line[-1].t / line[-1].s, 7) AS normalised FROM r JOIN u USING (user_id) WHERE i = len(u.c)""",
    "ctc_forward": """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS v, [0, vec_id % 2 + 1, 0, vec_id % 3 + 1, 0, vec_id % 4 + 1, 0] AS path FROM embeddings),
      f AS (SELECT vec_id, path, list_transform(range(0, len(v) // 8), lambda t: list_transform(v[t * 8 + 1 : t * 8 + 8], lambda x: x / list_sum(v[t * 8 + 1 : t * 8 + 8]))) AS p FROM e),
      r(vec_id, t, a) AS (SELECT vec_id, 1, list_transform(range(1, 8), lambda i: CASE WHEN i <= 2 THEN p[1][path[i] + 1] ELSE 0.0 END) FROM f
        UNION ALL SELECT r.vec_id, r.t + 1, list_transform(range(1, 8), lambda i: (r.a[i] + CASE WHEN i > 1 THEN r.a[i - 1] ELSE 0.0 END + CASE WHEN i > 2 AND f.path[i] <> 0 AND f.path[i] <> f.path[i - 2] THEN r.a[i - 2] ELSE 0.0 END) * f.p[r.t + 1][f.path[i] + 1]) FROM r JOIN f USING (vec_id) WHERE r.t < len(f.p))
      SELECT vec_id, round(ln(a[6] + a[7]), 6) AS log_likelihood, round(ln(a[6] + a[7]) / t, 6) AS mean_frame FROM r JOIN f USING (vec_id) WHERE t = len(f.p)""",
    "beam_decode": """WITH RECURSIVE l AS (SELECT l_orderkey AS doc, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3) AS i, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS arc, l_discount AS v FROM lineitem),
      r(doc, i, score, path) AS (SELECT DISTINCT doc, 0::BIGINT, 0.0::DOUBLE, []::VARCHAR[] FROM l UNION ALL SELECT r.doc, l.i, r.score + l.v, list_append(r.path, l.arc) FROM r JOIN l ON l.doc = r.doc AND l.i = r.i + 1),
      n AS (SELECT doc, max(i) AS i FROM l GROUP BY doc), o AS (SELECT doc, score, path, row_number() OVER (PARTITION BY doc ORDER BY score DESC, path) AS position FROM r JOIN n USING (doc, i))
      SELECT doc, position, round(score, 7) AS score, array_to_string(path, '|') AS path FROM o WHERE position <= 2""",
    "routed_plan": f"""WITH RECURSIVE {_ACTIONS}, st AS (SELECT kind, count(*) AS n, sum(disc) AS r FROM a WHERE line = 1 GROUP BY kind),
      k AS (SELECT g, count(DISTINCT kind) AS kinds FROM a GROUP BY g),
      b AS (SELECT a.*, u + 0.18 * greatest(-1.0 / kinds, least(1.0 / kinds, 1.0 / kinds - coalesce(n, 0) / (SELECT sum(n) FROM st)::DOUBLE)) + 0.12 * coalesce(r / n, 0.0) + 0.30 * crit AS base FROM a JOIN k USING (g) LEFT JOIN st USING (kind)),
      s(g, rest, used, taken, per, step, id, ok, score) AS (
        SELECT g, list({{'id': id, 'isl': isl, 'crit': crit, 'cost': cost, 'base': base}}), 0::BIGINT, 0, [0, 0, 0], -1::BIGINT, '', false, 0.0::DOUBLE FROM b GROUP BY g
        UNION ALL
        SELECT g, list_filter(rest, lambda x: x.id <> z.id), used + CASE WHEN f THEN z.cost ELSE 0 END, taken + f::INTEGER, list_transform(per, lambda x, j: x + CASE WHEN f AND j = z.isl + 1 THEN 1 ELSE 0 END), step + 1, z.id, f, -z.s
        FROM (SELECT *, taken < 4 AND -z.s >= 0 AND per[z.isl + 1] < 2 AND used + z.cost <= 9000 AS f
              FROM (SELECT *, list_sort(list_transform(rest, lambda x: {{'s': -(x.base - 0.45 * per[x.isl + 1]), 'c': -x.crit, 'cost': x.cost, 'id': x.id, 'isl': x.isl}}))[1] AS z FROM s WHERE len(rest) > 0)))
      SELECT g AS group_id, id AS action_id, ok AS selected, used AS used_ms, step, round(score, 6) AS score FROM s WHERE step >= 0""",
    "isotonic_pav": """WITH j AS (SELECT doc_id, (coalesce(n_chars, 0) % 1000) / 1000.0 AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
      p AS (SELECT x, count(*) AS w, sum(y) AS s, row_number() OVER (ORDER BY x) AS i FROM j GROUP BY x), c AS (SELECT x, i, w, s, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs FROM p),
      m AS (SELECT a.i AS a, e.i AS e, (e.cs - a.cs + a.s) / (e.cw - a.cw + a.w)::DOUBLE AS mean FROM c a JOIN c e ON e.i >= a.i),
      g AS (SELECT a, e AS i, min(mean) OVER (PARTITION BY a ORDER BY e DESC ROWS UNBOUNDED PRECEDING) AS v FROM m), f AS (SELECT i, max(v) AS v FROM g GROUP BY i)
      SELECT doc_id, round(v, 7) AS probability FROM j JOIN c USING (x) JOIN f USING (i)""",
    "platt_scaling": """WITH RECURSIVE j AS (SELECT doc_id, (coalesce(n_chars, 0) % 1000) / 1000.0 AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
      r(i, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL
        SELECT i + 1, greatest(1e-6, a - (ga * (hbb + 1e-3) - gb * hab) / ((haa + 1e-3) * (hbb + 1e-3) - hab * hab)), b - (gb * (haa + 1e-3) - ga * hab) / ((haa + 1e-3) * (hbb + 1e-3) - hab * hab)
        FROM (SELECT i, a, b, avg((p - y) * x) + 1e-3 * (a - 1) AS ga, avg(p - y) + 1e-3 * b AS gb, avg(p * (1 - p) * x * x) AS haa, avg(p * (1 - p) * x) AS hab, avg(p * (1 - p)) AS hbb
              FROM (SELECT r.*, j.x, j.y, 1 / (1 + exp(-(a * j.x + b))) AS p FROM r, j WHERE i < 30) GROUP BY i, a, b))
      SELECT doc_id, round(1 / (1 + exp(-(a * x + b))), 4) AS probability FROM j, r WHERE i = 30""",
    "hard_negatives": f"""WITH {_NEGATIVES}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY severity DESC, kind, x) AS place FROM firsts WHERE nth = 1)
      SELECT id, kind, severity::DOUBLE AS severity, s AS start, e AS "end", md5(x) AS text_md5 FROM o WHERE place <= 12""",
    "synthetic_examples": f"""WITH {_NEGATIVES}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY severity DESC, kind, x) + 1 AS place FROM firsts WHERE nth = 1), k AS (SELECT id, kind, severity::DOUBLE AS v, place, count(*) OVER (PARTITION BY id) + 1 AS n FROM o WHERE place <= 9)
      SELECT id AS group_id, printf('negative-%03d', place) AS candidate_id, kind, place AS rank, n AS hypothesis_count, round(greatest(0.05, 0.85 - 0.35 * v - place * 0.01), 7) AS acoustic, round(greatest(0.05, 0.86 - 0.40 * v), 7) AS mora, round(greatest(0.05, 0.90 - CASE WHEN kind = 'filler-delete' THEN 0.55 ELSE 0.20 END * v), 7) AS preservation, round(-0.12 - 0.28 * v - place * 0.01, 7) AS avg_logprob FROM k
      UNION ALL SELECT id, 'reference', 'none', 1, 9, 0.92, 0.94, 0.95, -0.08 FROM d WHERE length(t) > 0""",
    "greedy_plan": """WITH RECURSIVE a AS (SELECT l_orderkey AS g, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id, l_partkey % 3 AS isl, l_discount / (100 + l_quantity * 20) AS u, (100 + l_quantity * 100)::BIGINT AS cost,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount / (100 + l_quantity * 20) DESC, l_tax DESC, l_discount DESC, (100 + l_quantity * 100)::BIGINT, concat_ws('-', l_linenumber, l_partkey, l_suppkey)) AS i FROM lineitem),
      s AS (SELECT g, 0::BIGINT AS i, '' AS id, false AS ok, 0::BIGINT AS used, 0 AS taken, [0, 0, 0] AS per FROM (SELECT DISTINCT g FROM a)
        UNION ALL SELECT a.g, a.i, a.id, f, s.used + CASE WHEN f THEN a.cost ELSE 0 END, s.taken + f::INTEGER, list_transform(s.per, lambda x, j: x + CASE WHEN f AND j = a.isl + 1 THEN 1 ELSE 0 END)
        FROM s JOIN a ON a.g = s.g AND a.i = s.i + 1, LATERAL (SELECT s.per[a.isl + 1] < 2 AND a.u >= 4e-5 AND s.taken < 4 AND s.used + a.cost <= 9000 AS f))
      SELECT g AS group_id, id AS action_id, ok AS selected, used AS used_ms, i - 1 AS step FROM s WHERE i > 0""",
}
