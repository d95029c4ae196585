"""Score contracts, effort under pressure and classes of spans, over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import contracts, spans
from quillspark.plans.evidence import table
from quillspark.plans.measure_queries import L, R

_LINE = "concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_orderkey, round(l_extendedprice * 100)::BIGINT)"


def _line(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("line", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long")))


def score_domains(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", F.when(F.col("l_suppkey") % 11 == 0, F.lit("rank")).otherwise(F.lit("log_probability")).alias("semantics"), F.when(F.col("l_partkey") % 13 != 0, F.col("l_linestatus")).alias("domain"), F.when(F.col("l_tax") < 0.06, F.lit("mean_token")).otherwise(F.lit("sequence")).alias("normalization"))
    return contracts.score_domains(rows, "l_orderkey")


def score_preferences(spark, sf):
    rows = _line(spark, sf).withColumn("ll", -F.col("l_quantity") * (1 + F.col("l_discount")))
    return contracts.preferences(rows, "l_orderkey", "ll", temperature=3.0).select("line", R("preference"))


def logit_scores(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.select("vec_id", F.expr("transform(sequence(0, size(v) div 8 - 1), t -> slice(v, t * 8 + 1, 8))").alias("logits"), F.expr("transform(sequence(0, size(v) div 8 - 1), t -> cast(if((vec_id + t) % 5 = 0, -100, (vec_id + t) % 8) as int))").alias("labels"))
    return rows.select("vec_id", *[F.round(c, 6).alias(k) if k != "token_count" else c.cast("long").alias(k) for k, c in contracts.sequence_log_probability(F.col("logits"), F.col("labels")).items()])


def bounded_utilities(spark, sf):
    x = F.col("l_extendedprice") / 1000
    return _line(spark, sf).select("line", F.round(contracts.bounded_utility(x, center=30.0, scale=12.0), 7).alias("higher"), F.round(contracts.bounded_utility(x, center=30.0, scale=12.0, higher_is_better=False), 7).alias("lower"), F.round(contracts.length_normalised(-F.col("l_extendedprice"), F.col("l_quantity") + 1, center=-900.0, scale=400.0), 7).alias("document"))


def risk_control(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("sample_count"), F.round(F.avg("l_tax"), 9).alias("empirical_risk"), F.round(1 - F.avg("l_discount"), 9).alias("empirical_coverage"), F.round(1 - F.min("l_tax") - F.avg("l_discount") / 2, 9).alias("cumulative_posterior"))
    return g.select("l_suppkey", contracts.risk_permits(g, maximum_risk=0.0405, minimum_coverage=0.949, minimum_samples=20, verified=True).alias("permitted"))


def throttled_effort(spark, sf):
    rows = _line(spark, sf).select(
        "line", (F.col("l_quantity") / 30).alias("latency_ratio"), (F.col("l_discount") * 9).alias("memory_pressure"), (F.col("l_tax") * 11).alias("queue_pressure"), (F.col("l_partkey") % 10 / 10).alias("thermal_pressure"), (F.col("l_suppkey") % 3 == 0).alias("battery_saver"),
        (F.col("l_linenumber") % 4).cast("int").alias("level"), (F.col("l_partkey") % 12 + 1).alias("maximum_candidates"), (F.col("l_partkey") * 7 % 9000).alias("evidence_budget_ms"), (F.col("l_suppkey") % 9).alias("maximum_evidence_actions"), *[(F.col("l_partkey") % k != 0).alias(c) for k, c in ((5, "enable_neural_reranker"), (7, "enable_acoustic_verifier"), (2, "enable_second_ear"), (3, "enable_offline_teacher"))],
    )
    out = contracts.throttled_effort(rows)
    return out.select("line", R("pressure"), L("maximum_candidates"), L("evidence_budget_ms"), L("maximum_evidence_actions"), *contracts.OFF_AT, F.array_join("reasons", ",").alias("reasons"))


SPANS = [
    ("3人", ["4人"], "number-or-quantity", 1.0), ("12:30", ["12:40"], "number-or-quantity,date-or-time", 1.0), ("500円", ["600円"], "number-or-quantity,currency", 1.0), ("50%", ["五十パーセント"], "number-or-quantity,percentage,entity-or-domain-term,special-mora", 1.0),
    ("行かない", ["行く"], "negation-meaning-flip,particle-or-functional", 1.0), ("するはず", ["するべき"], "negation-meaning-flip,modality-or-intent,particle-or-functional", 1.0), ("つもり", ["予定だと思う"], "modality-or-intent,particle-or-functional,entity-or-domain-term", 0.93), ("えーと", ["ええと"], "disfluency-or-repair,particle-or-functional,special-mora", 0.82), ("を", ["に"], "particle-or-functional", 0.76),
    ("API", ["APL"], "latin-acronym-or-term", 0.91), ("会議", ["懐疑"], "entity-or-domain-term", 0.93), ("タワー", ["タワ"], "entity-or-domain-term,special-mora", 0.93), ("、", [""], "phonetic-or-punctuation", 0.45), ("学校に行くので", ["学校へ行くので"], "entity-or-domain-term", 0.93),
]


def span_classes(spark, sf):
    rows = spark.createDataFrame([(i, p, a) for i, (p, a, _, _) in enumerate(SPANS)], "id int, pivot string, alternatives array<string>").withColumn("kinds", spans.kinds(F.col("pivot"), F.col("alternatives")))
    return rows.select("id", F.array_join("kinds", ",").alias("kinds"), spans.criticality(F.col("kinds")).alias("criticality"))


QUERIES = {f.__name__: f for f in (score_domains, score_preferences, logit_scores, bounded_utilities, risk_control, throttled_effort, span_classes)}

SQL = {
    "score_domains": """WITH s AS (SELECT l_orderkey, CASE WHEN l_suppkey % 11 = 0 THEN 'rank' ELSE 'log_probability' END AS s, CASE WHEN l_partkey % 13 <> 0 THEN l_linestatus END AS d, l_tax < 0.06 AS n FROM lineitem),
      g AS (SELECT l_orderkey, CASE WHEN count(DISTINCT s) <> 1 THEN 'scores with different semantics' WHEN count(*) > count(d) THEN 'score without a domain' WHEN count(DISTINCT d) <> 1 THEN 'scores from different domains' WHEN count(DISTINCT n) <> 1 THEN 'scores with different normalization' END AS problem, min(d) AS d FROM s GROUP BY 1)
      SELECT l_orderkey, CASE WHEN problem IS NULL THEN d END AS domain, problem FROM g""",
    "score_preferences": f"WITH a AS (SELECT {_LINE} AS line, l_orderkey AS g, -l_quantity * (1 + l_discount) AS ll FROM lineitem), e AS (SELECT *, exp(greatest(-80.0, (ll - max(ll) OVER (PARTITION BY g)) / 3.0)) AS m FROM a) SELECT line, round(m / sum(m) OVER (PARTITION BY g), 7) AS preference FROM e",
    "logit_scores": """WITH t AS (SELECT vec_id, unnest(range(0, len(embedding) // 8)) AS t, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT vec_id, (vec_id + t) % 5 = 0 AS skip, v[t * 8 + 1 : t * 8 + 8] AS x, (vec_id + t) % 8 + 1 AS i FROM t)
      SELECT vec_id, round(sum(lp), 6) AS sum_logprob, round(sum(lp) / count(*), 6) AS average_logprob, count(*) AS token_count FROM (SELECT vec_id, x[i] - ln(list_sum(list_transform(x, lambda y: exp(y)))) AS lp FROM r WHERE NOT skip) GROUP BY vec_id""",
    "bounded_utilities": f"SELECT {_LINE} AS line, round(tanh((l_extendedprice / 1000 - 30) / 12), 7) AS higher, round(tanh((30 - l_extendedprice / 1000) / 12), 7) AS lower, round(tanh((-l_extendedprice / (l_quantity + 1) + 900) / 400), 7) AS document FROM lineitem",
    "risk_control": "WITH g AS (SELECT l_suppkey, count(*) AS n, round(avg(l_tax), 9) AS r, round(1 - avg(l_discount), 9) AS c, round(1 - min(l_tax) - avg(l_discount) / 2, 9) AS p FROM lineitem GROUP BY 1) SELECT l_suppkey, n >= 20 AND r <= 0.0405 AND c >= 0.949 AND p >= 0.949 AS permitted FROM g",
    "throttled_effort": f"""WITH a AS (SELECT {_LINE} AS line, l_quantity / 30 AS lat, l_discount * 9 AS mem, l_tax * 11 AS que, l_partkey % 10 / 10 AS hot, l_suppkey % 3 = 0 AS bat, l_linenumber % 4 AS lv, l_partkey % 12 + 1 AS mc, l_partkey * 7 % 9000 AS eb, l_suppkey % 9 AS ma, l_partkey AS p FROM lineitem)
      SELECT line, round(least(1.0, 0.34 * least(2.0, lat) / 2 + 0.26 * least(1.0, mem) + 0.18 * least(1.0, que) + 0.16 * least(1.0, hot) + 0.06 * bat::INTEGER), 7) AS pressure,
        greatest(1, round_even(mc * [1.0, 0.75, 0.5, 0.25][lv + 1]::DOUBLE, 0))::BIGINT AS maximum_candidates, round_even(eb * [1.0, 0.6, 0.25, 0.0][lv + 1]::DOUBLE, 0)::BIGINT AS evidence_budget_ms, round_even(ma * [1.0, 0.75, 0.5, 0.0][lv + 1]::DOUBLE, 0)::BIGINT AS maximum_evidence_actions,
        p % 5 <> 0 AND lv < 3 AS enable_neural_reranker, p % 7 <> 0 AND lv < 2 AS enable_acoustic_verifier, p % 2 <> 0 AND lv < 2 AS enable_second_ear, p % 3 <> 0 AND lv < 1 AS enable_offline_teacher,
        concat_ws(',', CASE WHEN lat >= 1 THEN 'latency-over-target' END, CASE WHEN mem >= 0.75 THEN 'memory-pressure' END, CASE WHEN que >= 0.75 THEN 'queue-pressure' END, CASE WHEN hot >= 0.75 THEN 'thermal-pressure' END, CASE WHEN bat THEN 'battery-saver' END, CASE WHEN lv > 0 THEN 'throttle-level-' || lv END) AS reasons FROM a""",
    "span_classes": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {c}::DOUBLE)" for i, (_, _, k, c) in enumerate(SPANS)) + ") v(id, kinds, criticality)",
}
