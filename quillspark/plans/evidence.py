"""Evidence tables derived from the shared tables, as DataFrames and as the same SQL for the comparison.

A line item plays a hypothesis of its order: price is its likelihood, quantity, discount and tax are evidence streams,
supplier its source, line status the domain within which likelihoods add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("candidate_id"),
        F.concat("l_returnflag", "l_linestatus", F.element_at(F.array(*[F.lit(x) for x in "abc"]), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("text"),
        (-(F.col("l_extendedprice") / 100000.0)).alias("avg_logprob"),
        F.lit(None).cast("double").alias("cumulative_logprob"),
        F.lit(None).cast("double").alias("acoustic"),
        (F.col("l_quantity") / 50.0).alias("mora"),
        (F.col("l_discount") * 10).alias("lexical"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax") * 12).alias("preservation"),
        F.lit(None).cast("double").alias("cross_model"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount") * 10).alias("teacher"),
        F.lit(None).cast("double").alias("sequence_score"),
        F.col("l_linenumber").cast("int").alias("rank"),
        F.lit(8).alias("hypothesis_count"),
        F.lit(None).cast("double").alias("beam_confidence"),
        F.col("l_linenumber").cast("int").alias("token_count"),
        (F.col("l_tax") > 0.075).alias("degenerate"),
        (F.col("l_suppkey") % 5 == 0).alias("second_ear"),
        F.concat(F.lit("src"), F.col("l_suppkey") % 3).alias("source"),
        F.col("l_linestatus").alias("domain"),
    )


CANDIDATES = """
c AS (
  SELECT l_orderkey AS group_id,
    concat_ws('-', l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), round(l_extendedprice * 100)::BIGINT) AS candidate_id,
    l_returnflag || l_linestatus || ['a', 'b', 'c'][l_partkey % 3 + 1] AS text, -(l_extendedprice / 100000.0) AS avg_logprob,
    NULL::DOUBLE AS acoustic, l_quantity / 50.0 AS mora, l_discount * 10 AS lexical, CASE WHEN l_linenumber <> 3 THEN l_tax * 12 END AS preservation,
    NULL::DOUBLE AS cross_model, CASE WHEN l_suppkey % 2 = 0 THEN l_discount * 10 END AS teacher, l_linenumber AS rank, 8 AS hypothesis_count,
    l_linenumber AS token_count, l_tax > 0.075 AS degenerate, l_suppkey % 5 = 0 AS second_ear, 'src' || (l_suppkey % 3) AS source, l_linestatus AS domain
  FROM lineitem
)"""

POOL = CANDIDATES + """,
pd0 AS (
  SELECT *, trim(text) AS pool_key, avg_logprob * (greatest(token_count, 1) + 1) AS lp,
    row_number() OVER (PARTITION BY group_id, trim(text), domain ORDER BY coalesce(avg_logprob, -1e30) DESC, coalesce(mora, -1e30) DESC, candidate_id DESC) AS pos
  FROM c
), pd1 AS (
  SELECT *, max(lp) OVER (PARTITION BY group_id, pool_key, domain) AS top FROM pd0
), pd2 AS (
  SELECT group_id, pool_key, domain, max(top) + ln(sum(exp(lp - top))) AS mass, count(*) AS path_count, list(DISTINCT source) AS sources,
    max(CASE WHEN pos = 1 THEN token_count END) AS token_count, max(CASE WHEN pos = 1 THEN candidate_id END) AS representative_id, max(CASE WHEN pos = 1 THEN text END) AS text,
    max(CASE WHEN pos = 1 THEN mora END) AS mora, max(CASE WHEN pos = 1 THEN lexical END) AS lexical, max(CASE WHEN pos = 1 THEN preservation END) AS preservation,
    max(CASE WHEN pos = 1 THEN teacher END) AS teacher, max(CASE WHEN pos = 1 THEN rank END) AS rank, max(CASE WHEN pos = 1 THEN degenerate END) AS degenerate, max(CASE WHEN pos = 1 THEN second_ear END) AS second_ear
  FROM pd1 GROUP BY ALL
), pd3 AS (
  SELECT *, mass / (greatest(token_count, 1) + 1) AS average FROM pd2
), pd4 AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, pool_key ORDER BY average DESC, coalesce(mora, -1e30) DESC, representative_id DESC) AS pos,
    sum(path_count) OVER (PARTITION BY group_id, pool_key) AS paths, count(*) OVER (PARTITION BY group_id, pool_key) AS domains FROM pd3
), ps AS (
  SELECT group_id, pool_key, count(DISTINCT s) AS source_count FROM (SELECT group_id, pool_key, unnest(sources) AS s FROM pd3) GROUP BY ALL
), p AS (
  SELECT pd4.group_id, pd4.pool_key, 'surface:' || lpad(row_number() OVER (PARTITION BY pd4.group_id ORDER BY pd4.pool_key)::VARCHAR, 4, '0') AS candidate_id, representative_id, text, paths AS path_count, domains, source_count,
    average AS avg_logprob, average AS acoustic, mass, mora, lexical, preservation, teacher, rank, 8 AS hypothesis_count, degenerate, second_ear,
    CASE WHEN source_count >= 2 THEN least(1.0, 0.62 + 0.12 * (source_count - 2))::DOUBLE END AS cross_model
  FROM pd4 JOIN ps USING (group_id, pool_key) WHERE pos = 1
)"""

_S = ("acoustic", "mora", "lexical", "preservation", "cross_model")
_PRIOR = {"acoustic": 0.42, "mora": 0.23, "lexical": 0.08, "preservation": 0.12, "cross_model": 0.15}
_FAMILY = ("acoustic", "mora", "cross_model")
_each = lambda f, sep=", ": sep.join(f(s) for s in _S)

FUSE = POOL + f""",
f0 AS (SELECT *, {_each(lambda s: f"median({s}) OVER g AS {s}_m, min({s}) OVER g >= 0 AND max({s}) OVER g <= 1 AS {s}_u")},
    count(avg_logprob) OVER g AS nlp, count(avg_logprob) OVER (PARTITION BY group_id, avg_logprob) AS tied FROM p WINDOW g AS (PARTITION BY group_id)),
f1 AS (SELECT *, {_each(lambda s: f"median(abs({s} - {s}_m)) OVER g AS {s}_d")},
    CASE WHEN nlp = 1 THEN 1.0 WHEN tied > 1 THEN 0.0 ELSE avg_logprob - lead(avg_logprob) OVER (PARTITION BY group_id ORDER BY avg_logprob DESC) END AS gap
  FROM f0 WINDOW g AS (PARTITION BY group_id)),
f2 AS (SELECT * REPLACE ({_each(lambda s: f"CASE WHEN {s}_u OR {s} IS NULL THEN {s} ELSE least(1 - 1e-9, greatest(1e-9, 1 / (1 + exp(-least(700, greatest(-700, ({s} - {s}_m) / greatest(0.05, 1.4826 * {s}_d))))))) END AS {s}")}),
    least(1.0, greatest(0.0, 0.55 * exp(least(0, avg_logprob)) + 0.25 * ((hypothesis_count - rank) / (hypothesis_count - 1)::DOUBLE) + 0.20 * coalesce(1 / (1 + exp(-gap / 0.15)), 0.5))) AS beam FROM f1),
f3 AS (SELECT * REPLACE (CASE WHEN acoustic IS NULL THEN beam ELSE 0.76 * acoustic + 0.24 * beam END AS acoustic) FROM f2),
f4 AS (SELECT *, {_each(lambda s: f"{_PRIOR[s]} * (0.30 + CASE WHEN count({s}) OVER g > 0 THEN count({s}) OVER g / (count(*) OVER g)::DOUBLE * least(1.0, 0.20 + 0.80 * (max({s}) OVER g - min({s}) OVER g)) ELSE 0 END) AS w_{s}")},
    bool_and(degenerate) OVER g AS all_bad, count(*) FILTER (WHERE NOT second_ear) OVER g AS n1, count(*) FILTER (WHERE NOT second_ear AND NOT degenerate) OVER g AS n1ok FROM f3 WINDOW g AS (PARTITION BY group_id)),
f5 AS (SELECT *, {_each(lambda s: f"w_{s}", " + ")} AS wt FROM f4),
f6 AS (SELECT * REPLACE ({_each(lambda s: f"w_{s} / wt AS w_{s}")}) FROM f5),
f7 AS (SELECT *, w_acoustic + w_mora + w_cross_model AS fam, w_lexical + w_preservation AS lang FROM f6),
f8 AS (SELECT * REPLACE ({_each(lambda s: f"CASE WHEN fam < 0.72 AND fam > 0 AND lang > 0 THEN w_{s} * " + ("0.72 / fam" if s in _FAMILY else "(1 - 0.72) / lang") + f" ELSE w_{s} END AS w_{s}")}),
    {_each(lambda s: f"exp(greatest(-80, least(80, (coalesce({s}, -8.0) - max(coalesce({s}, -8.0)) OVER g) / 0.20))) AS e_{s}, CASE WHEN count({s}) OVER g > 0 THEN 1 ELSE 0 END AS o_{s}")}
  FROM f7 WINDOW g AS (PARTITION BY group_id)),
f9 AS (SELECT *, {_each(lambda s: f"e_{s} / sum(e_{s}) OVER g AS d_{s}")}, {_each(lambda s: f"o_{s}", " + ")} AS used FROM f8 WINDOW g AS (PARTITION BY group_id)),
f10 AS (SELECT *, ({_each(lambda s: f"o_{s} * d_{s}", " + ")}) / greatest(used, 1) AS mx FROM f9),
f11 AS (SELECT *, ({_each(lambda s: f"CASE WHEN o_{s} = 1 AND d_{s} > 0 THEN d_{s} * ln((d_{s} + 1e-12) / (mx + 1e-12)) ELSE 0 END", " + ")}) / greatest(used, 1) AS kl FROM f10),
f12 AS (SELECT *, CASE WHEN used <= 1 THEN 0.0 ELSE least(1.0, greatest(0.0, sum(kl) OVER g / ln(greatest(count(*) OVER g, 2)))) END AS disagreement,
    {_each(lambda s: f"CASE WHEN {s} IS NOT NULL THEN w_{s} ELSE 0 END", " + ")} AS coverage, {_each(lambda s: f"w_{s} * coalesce({s}, 0)", " + ")} AS raw,
    (w_acoustic * coalesce(acoustic, 0) + w_mora * coalesce(mora, 0) + w_cross_model * coalesce(cross_model, 0)) / (w_acoustic + w_mora + w_cross_model) AS support FROM f11 WINDOW g AS (PARTITION BY group_id)),
f13 AS (SELECT *, raw - (1 - coverage) * 0.10 + 0.018 * least(3, greatest(0, source_count - 1)) - CASE WHEN teacher IS NOT NULL THEN 0.25 * greatest(0, teacher - support - 0.08) ELSE 0 END AS score FROM f12),
f14 AS (SELECT *, exp(greatest(-80, least(80, (score - max(score) OVER (PARTITION BY group_id)) / 0.14))) AS e FROM f13),
f15 AS (SELECT *, e / sum(e) OVER (PARTITION BY group_id) AS posterior FROM f14),
f16 AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY posterior DESC, score DESC, candidate_id) AS position, count(*) OVER (PARTITION BY group_id) AS n FROM f15),
f17 AS (SELECT *, max(CASE WHEN position = 1 THEN posterior END) OVER g AS top_posterior, coalesce(max(CASE WHEN position = 2 THEN posterior END) OVER g, 0) AS second, max(CASE WHEN position = 1 THEN coverage END) OVER g AS evidence_coverage,
    CASE WHEN n <= 1 THEN 0.0 ELSE least(1.0, greatest(0.0, -sum(posterior * ln(posterior + 1e-12)) OVER g / ln(greatest(n, 2)))) END AS entropy FROM f16 WINDOW g AS (PARTITION BY group_id)),
f18 AS (SELECT *, top_posterior - second AS margin, least(1.0, greatest(0.0, 0.56 * (1 - top_posterior) + 0.24 * disagreement + 0.20 * (1 - evidence_coverage))) AS selective_risk, n1 > 0 AND n1ok = 0 AS n1bad FROM f17),
f19 AS (SELECT *, all_bad OR n1bad OR entropy >= 0.55 OR disagreement >= 0.22 OR margin <= 0.18 OR selective_risk >= 0.32 OR evidence_coverage < 0.55 AS needs_relisten,
    all_bad OR n1bad OR (top_posterior < 0.64 AND (selective_risk >= 0.32 OR evidence_coverage < 0.55 OR disagreement >= 0.22)) AS abstain FROM f18),
f AS (SELECT *, concat_ws(',', CASE WHEN all_bad OR n1bad THEN 'all-candidates-degenerate' END, CASE WHEN n1bad AND NOT all_bad THEN 'all-primary-candidates-degenerate' END, CASE WHEN entropy >= 0.55 THEN 'high-candidate-entropy' END,
    CASE WHEN disagreement >= 0.22 THEN 'evidence-stream-disagreement' END, CASE WHEN margin <= 0.18 THEN 'small-posterior-margin' END, CASE WHEN selective_risk >= 0.32 THEN 'high-selective-risk' END,
    CASE WHEN evidence_coverage < 0.55 THEN 'low-evidence-coverage' END, CASE WHEN abstain THEN 'provisional-observation' END) AS reasons FROM f19)"""

RISK = FUSE + """,
r0 AS (SELECT h.group_id, h.candidate_id, h.posterior, t.posterior AS q,
    CASE WHEN h.text = t.text THEN 0.0 ELSE levenshtein(h.text, t.text) / greatest(length(h.text), length(t.text))::DOUBLE END AS surface, CASE WHEN h.text = t.text THEN 0.0 ELSE 1.0 END AS critical,
    CASE WHEN h.preservation IS NULL OR t.preservation IS NULL THEN 0 ELSE least(1.0, abs(h.preservation - t.preservation)) END AS preservation FROM f h JOIN f t USING (group_id)),
r1 AS (SELECT group_id, candidate_id, posterior, sum(q * least(2.0, 0.34 * surface + 0.30 * surface + 0.28 * critical + 0.08 * preservation)) AS risk, sum(q * surface) AS surface_risk, sum(q * critical) AS critical_risk, sum(q * preservation) AS preservation_risk FROM r0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(risk, 12), posterior DESC, candidate_id) AS position FROM r1),
m AS (SELECT group_id, max(CASE WHEN position = 1 THEN candidate_id END) AS mbr_id, max(CASE WHEN position = 1 THEN risk END) AS expected_risk,
    greatest(0, coalesce(max(CASE WHEN position = 2 THEN risk END), max(CASE WHEN position = 1 THEN risk END)) - max(CASE WHEN position = 1 THEN risk END)) AS risk_margin FROM r GROUP BY group_id)"""

ADAPT = """
a0 AS (SELECT group_id, candidate_id, text, posterior, selective_risk, n, least(12, n) AS top, row_number() OVER o AS i, sum(posterior) OVER (o ROWS UNBOUNDED PRECEDING) AS mass FROM f WINDOW o AS (PARTITION BY group_id ORDER BY posterior DESC, candidate_id)),
a1 AS (SELECT *, i >= CASE WHEN selective_risk >= 0.28 THEN least(top, least(2, top) + 3) ELSE least(2, top) END AND i >= least(2, n) AND (mass >= 0.94 OR posterior < 0.015) AS stop FROM a0 WHERE i <= top),
a2 AS (SELECT *, coalesce(min(CASE WHEN stop THEN i END) OVER (PARTITION BY group_id), top) AS k FROM a1),
a AS (SELECT group_id, max(k) AS k, least(1.0, max(mass)) AS cumulative_posterior, max(CASE WHEN i = k THEN CASE WHEN NOT stop THEN 'maximum-k' WHEN mass >= 0.94 THEN 'posterior-mass-target' ELSE 'negligible-incremental-mass' END END) AS reason,
    string_agg(candidate_id, ',' ORDER BY i) AS selected FROM a2 WHERE i <= k GROUP BY group_id)"""
