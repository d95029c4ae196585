"""Error rates, calibration, statistics, text and n-gram queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import context, enrich, evaluate, ngrams
from quillspark.plans.evidence import CANDIDATES, candidates, table

R = lambda c: F.round(c, 7).alias(c)
L = lambda c: F.col(c).cast("long").alias(c)


def ascii_text(c: str):
    """The whole text without characters that SQL's edit distance would count by their bytes."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^ -~]", "")


def _pairs(spark, sf):
    """Each turn as a hypothesis for the turn before it."""
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", "role", F.regexp_replace(ascii_text("text"), "[ \t\n]+", "").alias("reference"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.regexp_replace(ascii_text("text"), "[ \t\n]+", "").alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"])


_PAIRS = """
k AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'), '[ \t\n]+', '', 'g') AS x FROM conversations),
pr AS (SELECT a.conv_id, a.turn, a.role, a.x AS r, b.x AS h, CASE WHEN length(a.x) > 0 THEN levenshtein(a.x, b.x) / length(a.x)::DOUBLE WHEN length(b.x) = 0 THEN 0.0 END AS rate, levenshtein(a.x, b.x) AS d FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def cer_utterance_vs_corpus(spark, sf):
    rows = _pairs(spark, sf).withColumns({"units": F.length("reference"), "edits": F.levenshtein("reference", "hypothesis"), "rate": evaluate.cer(F.col("reference"), F.col("hypothesis"))})
    return evaluate.corpus_and_mean(rows, ["role"]).select("role", "n", "defined", R("utterance_mean"), R("corpus_rate"))


def slice_report(spark, sf):
    rows = _pairs(spark, sf).withColumn("rate", evaluate.cer(F.col("reference"), F.col("hypothesis")))
    ratio = F.try_divide(F.length("hypothesis"), F.length("reference"))
    labels = {"all": F.lit(True), "user": F.col("role") == "user", "shorter": ratio < 0.8, "similar": (ratio >= 0.8) & (ratio <= 1.2), "longer": ratio > 1.2}
    return evaluate.slices(rows, labels, [F.count("*").alias("n"), F.round(F.avg("rate"), 7).alias("mean_rate"), F.round(F.expr("percentile(rate, 0.9)"), 7).alias("p90")])


def oracle_at_k(spark, sf):
    rows = _pairs(spark, sf).select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("position"), evaluate.cer(F.col("reference"), F.col("hypothesis")).alias("rate"))
    return evaluate.oracle_at_k(rows).select("sample_id", "position", R("oracle"))


def annotation_counts(spark, sf):
    t = _annotated(spark, sf)
    return t.select("conv_id", "turn", *[v.cast("long").alias(k) for k, v in X.annotation_counts(F.col("x")).items()])


def spoken_surface(spark, sf):
    return _annotated(spark, sf).select("conv_id", "turn", X.spoken_surface(F.col("x")).alias("surface"))


def _annotated(spark, sf):
    """Each turn with marks on its words: of every eight one a filler, one a disfluency, one uncertain, and an inaudible and a masked one."""
    words = F.split(F.regexp_replace(ascii_text("text"), r"[()\[\]]", ""), " ")
    marked = {0: ("(F ", ")"), 2: ("(D2 ", ")"), 3: ("(?) ", ""), 5: ("[Noise] ", ""), 6: ("(? ", ")")}

    def mark(w, i):
        out = w
        for k, (left, right) in marked.items():
            out = F.when(i % 8 == k, F.concat(F.lit(left), w, F.lit(right))).otherwise(out)
        return out

    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(words, mark), " ").alias("x"))


_ANN = """
an AS (SELECT conv_id, turn, array_to_string(list_transform(w, lambda v, i: CASE (i - 1) % 8 WHEN 0 THEN '(F ' || v || ')' WHEN 2 THEN '(D2 ' || v || ')' WHEN 3 THEN '(?) ' || v WHEN 5 THEN '[Noise] ' || v WHEN 6 THEN '(? ' || v || ')' ELSE v END), ' ') AS x
  FROM (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'), '[()\\[\\]]', '', 'g'), ' ') AS w FROM conversations))"""


def critical_tokens(spark, sf):
    x = ascii_text("url")
    out = table(spark, sf, "pages").select("page_id", X.matches(x, X.NUMBER).alias("a"), X.matches(x, r"[A-Za-z][A-Za-z0-9+._/#-]*").alias("b"))
    return out.select("page_id", F.array_join("a", "|").alias("numbers"), F.array_join("b", "|").alias("names"))


def punctuation_multiset_f1(spark, sf):
    c = table(spark, sf, "conversations")
    p = X.matches(F.coalesce("text", F.lit("")), r"[!?:;.,]")
    a, b = c.select("conv_id", "turn", p.alias("a")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), p.alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.multiset_f1(F.col("a"), F.col("b")), 7).alias("f1"))


def context_jaccard(spark, sf):
    r = _pairs(spark, sf)
    return r.select("conv_id", "turn", F.round(X.jaccard(F.col("reference"), F.col("hypothesis")), 7).alias("jaccard"), F.round(X.dice(F.col("reference"), F.col("hypothesis")), 7).alias("dice"))


def array_edit_rate(spark, sf):
    r = _pairs(spark, sf).withColumns({"a": X.characters(F.col("reference")), "b": X.characters(F.col("hypothesis"))})
    return r.select("conv_id", "turn", X.array_edit_distance(F.col("a"), F.col("b")).cast("long").alias("edits"))


def catalog_dice_topk(spark, sf):
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.lower("p_brand").alias("phrase"), F.array(F.lower("p_type")).alias("aliases"), F.lit(None).cast("string").alias("reading"), F.array().cast("array<string>").alias("tags"), F.col("p_size").cast("double").alias("priority"))
    queries = table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.lower(F.concat("p_brand", F.lit(" "), "p_type")).alias("query"), F.lit("").alias("reading"))
    return context.select(queries, entries, limit=5, minimum=0.4).select("query_id", "entry_id", R("score"), L("position"))


def _scored(spark, sf):
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    p = F.least(F.lit(1.0), F.lit(0.05) + F.coalesce("n_chars", F.lit(0)) % 1000 / 1000.0)
    return d.join(y, "doc_id").select(F.col("doc_id").alias("id"), p.alias("p"), (F.col("quality") == 1).alias("y"))


_SC = "sc AS (SELECT d.doc_id AS id, least(1.0, 0.05 + (coalesce(n_chars, 0) % 1000) / 1000.0) AS p, (quality = 1) AS y FROM documents d JOIN labels l USING (doc_id))"


def ece_bins(spark, sf):
    return evaluate.calibration_error(_scored(spark, sf)).select(R("ece"), R("brier"), R("nll"), "n")


def temperature_grid(spark, sf):
    return evaluate.temperature_grid(_scored(spark, sf)).select("temperature", R("nll"), "best")


def aurc(spark, sf):
    return evaluate.area_under_risk_coverage(_scored(spark, sf).select("id", F.col("p").alias("confidence"), F.col("y").alias("correct"))).select(R("aurc"), "n")


def ltt_select_k(spark, sf):
    li = table(spark, sf, "lineitem")
    obs = li.select(F.col("l_linenumber").cast("long").alias("k"), F.col("l_orderkey").alias("group_id"), (F.col("l_discount") * (1.5 - F.col("l_linenumber") * 0.1)).alias("loss"), (F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("cost"))
    return evaluate.learn_then_test(obs).select("k", "samples", "groups", R("risk"), R("mean_cost"), R("upper"), "accepted", "selected")


def policy_bounds(spark, sf):
    li = table(spark, sf, "lineitem")
    pol = li.select(F.concat(F.lit("p"), F.col("l_suppkey") % 9).alias("policy_id"), (F.col("l_suppkey") % 9 % 4 + 1).alias("candidate_count")).distinct()
    out = li.select(F.concat(F.lit("p"), F.col("l_suppkey") % 9).alias("policy_id"), (F.col("l_discount") * (F.col("l_suppkey") % 9 + 1) / 5).alias("loss"), F.col("l_quantity").alias("cost"))
    return evaluate.policy_bounds(pol, out, target=0.08).select("policy_id", "samples", R("risk"), R("mean_cost"), R("upper"), "passed", F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def pareto_2d(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return evaluate.pareto_sorted(p, cost="p_retailprice", quality="p_size", group="p_brand").select("p_brand", "p_partkey")


def pareto_3d(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("quality"), (F.col("s_suppkey") % 17).alias("latency"), (F.col("s_nationkey") % 7).alias("memory"))
    return evaluate.pareto(s, ["quality"], ["latency", "memory"], "s_suppkey").select("s_suppkey")


def paired_cohort_check(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.sum("l_discount").alias("b"))
    both = li.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_orderkey") % 50).alias("group_id"), F.explode(F.array(F.struct(F.lit("base").alias("system"), F.col("a").alias("value")), F.struct(F.lit("new").alias("system"), F.col("b").alias("value")))).alias("x")).select("sample_id", "group_id", "x.system", "x.value")
    return evaluate.paired_cohort(both, "base", "new").groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.sum("baseline"), 4).alias("baseline"), F.round(F.sum("candidate"), 4).alias("candidate"))


def claim_gate(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("groups"), F.round(F.avg("l_discount") - 0.05, 9).alias("upper"), F.round(F.avg("l_tax"), 9).alias("t"), F.avg("l_quantity").alias("q"))
    rows = g.select("l_suppkey", "groups", (F.col("upper") - 0.01).alias("lower"), "upper", F.round(1 - F.col("t"), 9).alias("better"), F.round(F.col("t") - 0.04, 9).alias("critical_delta"), F.round(F.col("q") / 13, 9).alias("latency_ratio"))
    return evaluate.claim_gate(rows).select("l_suppkey", "passed", F.array_join("reasons", ",").alias("reasons"))


def loop_guard_never_empty(spark, sf):
    return enrich.loop_guard(candidates(spark, sf)).select("group_id", "candidate_id", L("rejected"))


def minmax_enrich(spark, sf):
    return enrich.minmax_lexical(candidates(spark, sf).withColumn("raw", F.when(F.col("rank") != 2, F.col("mora"))), "raw").select("group_id", "candidate_id", R("lexical"))


def second_ear_agreement(spark, sf):
    rows = candidates(spark, sf).select("group_id", "candidate_id", "text", "cross_model", "second_ear")
    second = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("group_id"), F.concat("o_orderstatus", F.lit("Oa")).alias("second_text"))
    out = enrich.second_ear(rows, second, add=True)
    return out.select("group_id", "candidate_id", "text", R("cross_model"), L("hypothesis_count"))


def _tokens(spark, sf):
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.matches(low, r"[a-z]+").alias("tokens"))


def ngram_counts(spark, sf):
    return ngrams.count(_tokens(spark, sf), 2).select(L("n"), "context", "target", "c")


def ngram_backoff_score(spark, sf):
    t = _tokens(spark, sf)
    return ngrams.score(t, ngrams.count(t.where("id % 2 = 0"), 2), 2).select("id", "tokens", "unknown", F.round("total", 5).alias("total"), R("average"))


def suffix_cache_lookup(spark, sf):
    e = table(spark, sf, "events")
    seq = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("tokens"))
    at = seq.select(F.col("user_id").alias("id"), F.posexplode("tokens").alias("pos", "target"), "tokens").select("id", "pos", "target", F.slice("tokens", F.greatest(F.col("pos") - 2, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(2))).alias("history"))
    cache = at.where("id % 2 = 0").select("target", F.explode(F.transform(F.sequence(F.lit(0), F.size("history")), lambda n: F.array_join(F.slice("history", F.size("history") - n + 1, n), "\u0001"))).alias("context")).groupBy("context", "target").agg(F.count("*").alias("c")).where("c >= 12 and target <> 'view'").select("context", "target", (-F.round(F.lit(1.0) / F.col("c"), 9)).alias("log_probability"))
    return ngrams.suffix_lookup(at, cache, maximum=2).select("id", L("pos"), R("log_probability"), L("matched_order"), "exact", L("backoff_steps"))


def surprisal_quantile_rank(spark, sf):
    return ngrams.surprisal_threshold(table(spark, sf, "events"), "value", 0.95)


QUERIES = {f.__name__: f for f in (cer_utterance_vs_corpus, slice_report, oracle_at_k, annotation_counts, spoken_surface, critical_tokens, punctuation_multiset_f1, context_jaccard, array_edit_rate, catalog_dice_topk, ece_bins, temperature_grid, aurc, ltt_select_k, policy_bounds, pareto_2d, pareto_3d, paired_cohort_check, claim_gate, loop_guard_never_empty, minmax_enrich, second_ear_agreement, ngram_counts, ngram_backoff_score, suffix_cache_lookup, surprisal_quantile_rank)}

_GRAMS = lambda c: f"list_distinct(CASE WHEN length({c}) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, greatest(2, length({c}))), lambda i: substring({c}, i, 2)) END)"
_TOK = """
tk AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS w FROM documents),
ps AS (SELECT id, unnest(range(1, len(w) + 2)) AS i, unnest(list_append(w, '</s>')) AS target, unnest(list_prepend('<s>', w)) AS prev FROM tk WHERE len(w) > 0)"""

SQL = {
    "cer_utterance_vs_corpus": f"WITH {_PAIRS} SELECT role, count(*) AS n, count(rate) AS defined, round(avg(rate), 7) AS utterance_mean, round(sum(d) FILTER (WHERE rate IS NOT NULL) / sum(length(r)) FILTER (WHERE rate IS NOT NULL)::DOUBLE, 7) AS corpus_rate FROM pr GROUP BY role",
    "slice_report": f"WITH {_PAIRS}, q AS (SELECT *, length(h) / nullif(length(r), 0)::DOUBLE AS ratio FROM pr), s AS (SELECT 'all' AS slice, rate FROM q UNION ALL SELECT 'user', rate FROM q WHERE role = 'user' UNION ALL SELECT 'shorter', rate FROM q WHERE ratio < 0.8 UNION ALL SELECT 'similar', rate FROM q WHERE ratio >= 0.8 AND ratio <= 1.2 UNION ALL SELECT 'longer', rate FROM q WHERE ratio > 1.2) SELECT slice, count(*) AS n, round(avg(rate), 7) AS mean_rate, round(quantile_cont(rate, 0.9), 7) AS p90 FROM s GROUP BY slice",
    "oracle_at_k": f"WITH {_PAIRS} SELECT conv_id AS sample_id, turn AS position, round(min(rate) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 7) AS oracle FROM pr",
    "annotation_counts": f"""WITH {_ANN} SELECT conv_id, turn, len(regexp_extract_all(x, '\\(F\\s+([^()]*)\\)')) AS fillers, len(regexp_extract_all(x, '\\(D2?\\s+([^()]*)\\)')) AS disfluencies, len(regexp_extract_all(x, '\\(\\?\\s+([^()]*)\\)')) + len(regexp_extract_all(x, '\\(\\?\\)')) AS uncertain, len(regexp_extract_all(x, '\\[[A-Za-z][A-Za-z0-9_-]*\\]')) AS masked FROM an""",
    "spoken_surface": f"""WITH {_ANN} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\(F\\s+([^()]*)\\)', '\\1', 'g'), '\\(D2?\\s+([^()]*)\\)', '\\1', 'g'), '\\(\\?\\s+([^()]*)\\)', '\\1', 'g'), '\\(\\?\\)', '', 'g'), '\\s+', ' ', 'g')) AS surface FROM an""",
    "critical_tokens": "SELECT page_id, array_to_string(regexp_extract_all(x, '[0-9][0-9,.:/-]*'), '|') AS numbers, array_to_string(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9+._/#-]*'), '|') AS names FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '[^ -~]', '', 'g') AS x FROM pages)",
    "punctuation_multiset_f1": "WITH p AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[!?:;.,]') AS a FROM conversations), j AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1), m AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda v: least(len(list_filter(a, lambda z: z = v)), len(list_filter(b, lambda z: z = v))))) AS s FROM j) SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 OR coalesce(s, 0) = 0 THEN 0.0 ELSE round(2.0 * s / (len(a) + len(b)), 7) END AS f1 FROM m",
    "context_jaccard": f"WITH {_PAIRS}, g AS (SELECT conv_id, turn, {_GRAMS('r')} AS a, {_GRAMS('h')} AS b FROM pr), i AS (SELECT *, len(list_intersect(a, b)) AS n FROM g) SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(n / (len(a) + len(b) - n)::DOUBLE, 7) END AS jaccard, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(2.0 * n / (len(a) + len(b)), 7) END AS dice FROM i",
    "array_edit_rate": f"WITH {_PAIRS} SELECT conv_id, turn, levenshtein(r, h) AS edits FROM pr",
    "ece_bins": f"WITH {_SC}, b AS (SELECT *, len(list_filter(list_transform(range(1, 15), lambda i: i / 15.0::DOUBLE), lambda e: p >= e)) AS bin, least(1 - 1e-9, greatest(1e-9, p)) AS q, y::INTEGER AS z FROM sc), g AS (SELECT bin, count(*) AS n, sum(p) AS sp, sum(z) AS sy, sum((q - z) * (q - z)) AS b, sum(-(z * ln(q) + (1 - z) * ln(1 - q))) AS l FROM b GROUP BY bin) SELECT round(sum(abs(sp - sy)) / sum(n), 7) AS ece, round(sum(b) / sum(n), 7) AS brier, round(sum(l) / sum(n), 7) AS nll, sum(n)::BIGINT AS n FROM g",
    "temperature_grid": f"WITH {_SC}, t AS (SELECT unnest([0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0]::DOUBLE[]) AS temperature), q AS (SELECT temperature, y::INTEGER AS z, least(1 - 1e-9, greatest(1e-9, 1 / (1 + exp(-ln(least(1 - 1e-9, greatest(1e-9, p)) / (1 - least(1 - 1e-9, greatest(1e-9, p)))) / temperature)))) AS q FROM sc, t), g AS (SELECT temperature, -avg(z * ln(q) + (1 - z) * ln(1 - q)) AS nll FROM q GROUP BY temperature) SELECT temperature, round(nll, 7) AS nll, row_number() OVER (ORDER BY nll, temperature) = 1 AS best FROM g",
    "aurc": f"WITH {_SC}, a AS (SELECT row_number() OVER o AS i, sum(CASE WHEN y THEN 0 ELSE 1 END) OVER (o ROWS UNBOUNDED PRECEDING) AS e, count(*) OVER () AS n FROM sc WINDOW o AS (ORDER BY p DESC, id)), r AS (SELECT i, n, e / i::DOUBLE AS risk FROM a) SELECT round(sum((risk + coalesce(lag_risk, 0)) / 2 / n), 7) AS aurc, count(*) AS n FROM (SELECT *, lag(risk) OVER (ORDER BY i) AS lag_risk FROM r)",
    "ltt_select_k": "WITH g AS (SELECT l_linenumber::BIGINT AS k, l_orderkey, avg(l_discount * (1.5 - l_linenumber * 0.1)) AS loss, count(*) AS n, sum(l_linenumber * 100 + l_quantity) AS cost FROM lineitem GROUP BY ALL), e AS (SELECT k, sum(n)::BIGINT AS samples, count(*) AS groups, avg(loss) AS risk, sum(cost) / sum(n) AS mean_cost FROM g GROUP BY k), u AS (SELECT *, CASE WHEN groups >= 30 THEN least(1.0, risk + sqrt(ln(count(*) OVER () / 0.05) / (2.0 * groups))) ELSE 1.0 END AS upper FROM e), a AS (SELECT *, groups >= 30 AND upper <= 0.10 AS accepted FROM u) SELECT k, samples, groups, round(risk, 7) AS risk, round(mean_cost, 7) AS mean_cost, round(upper, 7) AS upper, accepted, accepted AND row_number() OVER (ORDER BY accepted DESC, mean_cost, k) = 1 AS selected FROM a",
    "policy_bounds": "WITH e AS (SELECT 'p' || (l_suppkey % 9) AS policy_id, max(l_suppkey % 9 % 4 + 1) AS cc, count(*) AS samples, avg(l_discount * (l_suppkey % 9 + 1) / 5) AS risk, avg(l_quantity) AS mean_cost FROM lineitem GROUP BY 1), u AS (SELECT *, least(1.0, risk + sqrt(ln(count(*) OVER () / 0.05) / (2.0 * samples))) AS upper FROM e), p AS (SELECT *, samples >= 30 AND upper <= 0.08 AS passed FROM u) SELECT policy_id, samples, round(risk, 7) AS risk, round(mean_cost, 7) AS mean_cost, round(upper, 7) AS upper, passed, CASE WHEN passed THEN row_number() OVER (ORDER BY passed DESC, mean_cost, cc, policy_id) ELSE 0 END AS place FROM p",
    "pareto_2d": "SELECT a.p_brand, a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))",
    "pareto_3d": "WITH s AS (SELECT s_suppkey AS k, s_acctbal AS q, s_suppkey % 17 AS l, s_nationkey % 7 AS m FROM supplier) SELECT k AS s_suppkey FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k <> a.k AND b.q >= a.q AND b.l <= a.l AND b.m <= a.m AND (b.q > a.q OR b.l < a.l OR b.m < a.m))",
    "paired_cohort_check": "WITH o AS (SELECT l_orderkey, sum(l_quantity) AS a, sum(l_discount) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey % 50 AS group_id, count(*) AS n, round(sum(a), 4) AS baseline, round(sum(b), 4) AS candidate FROM o GROUP BY 1",
    "claim_gate": "WITH g AS (SELECT l_suppkey, count(*) AS n, round(avg(l_discount) - 0.05, 9) AS upper, round(avg(l_tax), 9) AS t, avg(l_quantity) AS q FROM lineitem GROUP BY 1), r AS (SELECT *, concat_ws(',', CASE WHEN n < 2 THEN 'insufficient-independent-resampling-units' END, CASE WHEN upper >= 0 THEN 'paired-confidence-interval-does-not-show-improvement' END, CASE WHEN round(1 - t, 9) < 0.95 THEN 'bootstrap-better-probability-below-threshold' END, CASE WHEN round(t - 0.04, 9) > 0 THEN 'critical-metric-regression' END, CASE WHEN round(q / 13, 9) > 2 THEN 'latency-ratio-exceeds-threshold' END) AS reasons FROM g) SELECT l_suppkey, reasons = '' AS passed, reasons FROM r",
    "loop_guard_never_empty": f"WITH {CANDIDATES}, m AS (SELECT *, sum(degenerate::INTEGER) OVER (PARTITION BY group_id) AS b, count(*) OVER (PARTITION BY group_id) AS n FROM c) SELECT group_id, candidate_id, CASE WHEN b = n THEN 0 ELSE b END::BIGINT AS rejected FROM m WHERE NOT degenerate OR b = n",
    "minmax_enrich": f"WITH {CANDIDATES}, m AS (SELECT *, CASE WHEN rank <> 2 THEN mora END AS raw FROM c), w AS (SELECT *, min(raw) OVER (PARTITION BY group_id) AS lo, max(raw) OVER (PARTITION BY group_id) AS hi FROM m) SELECT group_id, candidate_id, round(coalesce(CASE WHEN raw IS NULL THEN NULL WHEN hi - lo < 1e-12 THEN 1.0 ELSE (raw - lo) / (hi - lo) END, lexical), 7) AS lexical FROM w",
    "second_ear_agreement": f"WITH {CANDIDATES}, s AS (SELECT o_orderkey AS group_id, o_orderstatus || 'Oa' AS t FROM orders WHERE o_orderkey % 3 <> 0), j AS (SELECT c.group_id, candidate_id, text, CASE WHEN t IS NOT NULL THEN 1 - least(1.0, levenshtein(text, t) / length(text)::DOUBLE) END AS cm FROM c LEFT JOIN s USING (group_id)), u AS (SELECT * FROM j UNION ALL SELECT s.group_id, 'second-ear:0001', t, NULL FROM s SEMI JOIN c USING (group_id) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.group_id = s.group_id AND c.text = s.t)) SELECT group_id, candidate_id, text, round(cm, 7) AS cross_model, count(*) OVER (PARTITION BY group_id) AS hypothesis_count FROM u",
    "catalog_dice_topk": f"WITH q AS (SELECT p_partkey AS qid, lower(p_brand || ' ' || p_type) AS q FROM part WHERE p_partkey % 50 = 0), e AS (SELECT p_partkey AS eid, p_size::DOUBLE AS pr, lower(p_brand) AS s FROM part UNION ALL SELECT p_partkey, p_size, lower(p_type) FROM part), x AS (SELECT qid, eid, pr, q, s, {_GRAMS('q')} AS a, {_GRAMS('s')} AS b FROM q, e), y AS (SELECT *, CASE WHEN q = s THEN 1.0 WHEN contains(q, s) THEN 0.98 WHEN length(q) >= 2 AND contains(s, q) THEN least(0.94, 0.72 + 0.22 * length(q) / length(s)) ELSE 0.72 * greatest(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 1 - levenshtein(q, s) / greatest(length(q), length(s))::DOUBLE) END AS score FROM x), g AS (SELECT qid, eid, pr, max(score) AS score FROM y WHERE score >= 0.4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pr DESC, eid) AS position FROM g) SELECT qid AS query_id, eid AS entry_id, round(score, 7) AS score, position FROM r WHERE position <= 5",
    "ngram_counts": f"WITH {_TOK} SELECT 1::BIGINT AS n, '' AS context, target, count(*) AS c FROM ps GROUP BY target UNION ALL SELECT 2, prev, target, count(*) FROM ps GROUP BY prev, target",
    "ngram_backoff_score": f"WITH {_TOK}, tr AS (SELECT * FROM ps WHERE id % 2 = 0), u AS (SELECT target, count(*) AS c FROM tr GROUP BY 1), b AS (SELECT prev, target, count(*) AS c FROM tr GROUP BY ALL), t AS (SELECT prev, count(*) AS c FROM tr GROUP BY 1), v AS (SELECT count(*) + 1 AS v, sum(c) AS n FROM u), s AS (SELECT ps.id, u.c AS uc, CASE WHEN coalesce(t.c, 0) > 0 THEN ln((coalesce(b.c, 0) + 0.1) / (t.c + 0.1 * v)) ELSE ln((coalesce(u.c, 0) + 0.1) / (n + 0.1 * v)) - 0.12 END AS lp FROM ps CROSS JOIN v LEFT JOIN u ON u.target = ps.target LEFT JOIN t ON t.prev = ps.prev LEFT JOIN b ON b.prev = ps.prev AND b.target = ps.target) SELECT id, count(*) - 1 AS tokens, count(*) FILTER (WHERE uc IS NULL) AS unknown, round(sum(lp), 5) AS total, round(sum(lp) / count(*), 7) AS average FROM s GROUP BY id",
    "surprisal_quantile_rank": "SELECT quantile_disc(value, 0.95) AS threshold, count(value) AS n FROM events",
    "suffix_cache_lookup": """WITH a AS (SELECT user_id AS id, event_type AS target, row_number() OVER o - 1 AS pos, lag(event_type, 1) OVER o AS h1, lag(event_type, 2) OVER o AS h2 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
      k AS (SELECT ctx, target, -round(1.0 / count(*), 9) AS lp FROM (SELECT target, '' AS ctx FROM a WHERE id % 2 = 0 UNION ALL SELECT target, h1 FROM a WHERE id % 2 = 0 AND h1 IS NOT NULL UNION ALL SELECT target, h2 || chr(1) || h1 FROM a WHERE id % 2 = 0 AND h2 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 12 AND target <> 'view'),
      j AS (SELECT a.*, least(2, pos) AS most, k0.lp AS l0, k1.lp AS l1, k2.lp AS l2 FROM a LEFT JOIN k k0 ON k0.ctx = '' AND k0.target = a.target LEFT JOIN k k1 ON k1.ctx = h1 AND k1.target = a.target LEFT JOIN k k2 ON k2.ctx = h2 || chr(1) || h1 AND k2.target = a.target)
      SELECT id, pos, round(CASE WHEN l2 IS NOT NULL THEN l2 - 0.35 * (most - 2) WHEN l1 IS NOT NULL THEN l1 - 0.35 * (most - 1) WHEN l0 IS NOT NULL THEN l0 - 0.35 * most ELSE -12.0 END, 7) AS log_probability, CASE WHEN l2 IS NOT NULL THEN 2 WHEN l1 IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS matched_order,
        CASE WHEN l2 IS NOT NULL THEN most = 2 WHEN l1 IS NOT NULL THEN most = 1 WHEN l0 IS NOT NULL THEN most = 0 ELSE false END AS exact, CASE WHEN l2 IS NOT NULL THEN most - 2 WHEN l1 IS NOT NULL THEN most - 1 WHEN l0 IS NOT NULL THEN most ELSE most + 1 END::BIGINT AS backoff_steps FROM j""",
}
