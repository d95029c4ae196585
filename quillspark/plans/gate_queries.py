"""Gates, policies, teachers and sinks over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import choice, distil, enrich, evaluate, gates
from quillspark.plans.evidence import CANDIDATES, candidates, table
from quillspark.sources import sinks

R = lambda c: F.round(c, 7).alias(c)


def proposal_gate(spark, sf):
    o = table(spark, sf, "orders")
    prop = choice.with_kernels(o.select(
        F.col("o_orderkey").alias("group_id"), F.lit("ger").alias("proposal_id"), F.concat("o_orderstatus", F.lit("Oa")).alias("text"), (0.6 + F.col("o_orderkey") % 40 / 100).alias("acoustic"), (0.7 + F.col("o_orderkey") % 30 / 100).alias("mora_score"),
        (0.8 + F.col("o_orderkey") % 20 / 100).alias("coverage"), (F.col("o_orderkey") % 9 != 0).alias("calibrated"),
    )).withColumnRenamed("mora_score", "mora")
    out = gates.proposal_gate(prop, choice.with_kernels(candidates(spark, sf).select("group_id", "candidate_id", "text")))
    return out.select("group_id", "nearest_id", R("joint"), R("surface_distance"), "critical_change", "decision", F.array_join("reasons", ",").alias("reasons"))


def phone_policy(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("i", F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"))
    rows = li.select(F.col("l_orderkey").alias("group_id"), F.format_string("c%02d", "i").alias("candidate_id"), F.concat("l_returnflag", F.lit("bcdef"), "l_linestatus").alias("text"), (F.col("l_partkey") % 2).cast("string").alias("phones"), F.col("l_discount").alias("phone"), F.col("l_tax").alias("language"), (F.col("i") == 1).alias("baseline"))
    return gates.phone_policy(rows, language_weight=0.5, minimum_gain=0.005).select("group_id", "selected_id", "selected_text", "changed", "reason")


def fallback_guard(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("b_text"), F.when(F.col("p_partkey") % 7 != 0, F.concat("p_brand", F.col("p_partkey") % 2)).alias("p_text"), F.lit("x").alias("b_phones"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("y").alias("p_phones"),
        (F.col("p_size") / 50).alias("b_phone"), (F.col("p_partkey") % 50 / 50).alias("p_phone"), (F.col("p_retailprice") % 7).alias("b_language"), (F.col("p_retailprice") % 5).alias("p_language"),
    )
    return gates.fallback_guard(rows, floor=0.2, same_phone=True, language_weight=0.1).select("p_partkey", "veto", "reason")


def _judgments(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"), "l_discount", "l_tax", "l_quantity").dropDuplicates(["group_id", "candidate_id"])
    t = lambda name, score, kind, rel, off: F.struct(F.lit(name).alias("teacher"), score.alias("score"), F.lit(kind).alias("kind"), F.lit(rel).alias("reliability"), off.alias("abstained"))
    never = F.lit(False)
    return li.select("group_id", "candidate_id", F.explode(F.array(t("a", F.col("l_discount") + 0.01, "probability", 0.9, never), t("b", F.col("l_quantity") / 10, "logit", 0.5, never), t("c", F.col("l_tax") + 0.02, "probability", 0.7, F.col("group_id") % 4 == 0))).alias("t")).select("group_id", "candidate_id", "t.*")


def teacher_agreement(spark, sf):
    _, groups = distil.teacher_consensus(_judgments(spark, sf))
    return groups.select("group_id", R("disagreement"), "active", "usable", F.array_join("reasons", ",").alias("reasons"))


def teacher_preference(spark, sf):
    preference, _ = distil.teacher_consensus(_judgments(spark, sf))
    return distil.preference_losses(preference)


def decoupled_top_k(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"), (F.col("l_discount") * 20).alias("teacher"), (F.col("l_tax") * 20).alias("student")).dropDuplicates(["group_id", "candidate_id"])
    return distil.decoupled_top_k(rows, k=2).select("group_id", R("mass_kl"), R("inner_kl"), R("loss"))


def guarded_scores(spark, sf):
    c = candidates(spark, sf).withColumns({"ranker": F.col("lexical") * 2, "acoustic": F.col("mora")})
    return enrich.guarded_scores(c).select("group_id", "candidate_id", R("guarded"))


def deployment_gate(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("d"), F.round(F.avg("l_tax"), 9).alias("t"), F.round(F.avg("l_quantity"), 9).alias("q"))
    names = {**{k: F.lit("same") for k in evaluate.IDENTITIES}, "calibration": F.lit("c"), **{k: F.col("d") for k in evaluate.REGRESSIONS}, **{k: F.col("q") for k in evaluate.RATIOS}, "replay_rate": F.lit(1.0)}
    other = {**{k: F.lit("same") for k in evaluate.IDENTITIES}, "calibration": F.when(F.col("l_suppkey") % 5 != 0, "c"), **{k: F.col("t") + 0.01 for k in evaluate.REGRESSIONS}, **{k: F.lit(25.0) for k in evaluate.RATIOS}, "replay_rate": 1.0 - F.col("l_suppkey") % 3 / 1000}
    pairs = s.select("l_suppkey", *[v.alias(f"b_{k}") for k, v in names.items()], *[v.alias(f"c_{k}") for k, v in other.items()])
    return evaluate.deployment_gate(pairs).select("l_suppkey", "accepted", F.array_join("reasons", ",").alias("reasons"))


def subtitles_srt(spark, sf):
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    rows = c.select(F.col("conv_id").alias("recording"), F.col("turn").alias("index"), (F.col("turn") * 28_345).alias("start_ms"), (F.col("turn") * 28_345 + 27_001).alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"))
    return sinks.subtitles(rows).select("recording", "index", F.md5(F.encode("block", "UTF-8")).alias("block_md5"))


def cache_upsert(spark, sf):
    # Both halves are functions of the rows alone (every order is in one of them), since each is computed by itself.
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("key"), F.coalesce(F.col("o_orderkey") % 2 == 0, F.lit(False)).alias("even"), at.alias("at"))
    old, new = o.where("even"), o.where("not even")
    return sinks.upsert(old.groupBy("key").agg(F.max("at").alias("at")), new.select("key", "at").distinct(), ["key"], "at").select("key", F.col("at").cast("long").alias("newest"))


QUERIES = {f.__name__: f for f in (proposal_gate, phone_policy, fallback_guard, teacher_agreement, teacher_preference, decoupled_top_k, guarded_scores, deployment_gate, subtitles_srt, cache_upsert)}

_LD = lambda a, b: f"CASE WHEN {a} = {b} THEN 0.0 ELSE levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
_J = "j AS (SELECT DISTINCT ON (l_orderkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey)) l_orderkey AS g, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS c, l_discount, l_tax, l_quantity FROM lineitem)"
SQL = {
    "proposal_gate": f"""WITH {CANDIDATES}, p AS (SELECT o_orderkey AS g, o_orderstatus || 'Oa' AS t, 0.6 + (o_orderkey % 40) / 100.0 AS ac, 0.7 + (o_orderkey % 30) / 100.0 AS mo, 0.8 + (o_orderkey % 20) / 100.0 AS co, o_orderkey % 9 <> 0 AS cal FROM orders),
      n AS (SELECT p.*, c.candidate_id, c.text, {_LD('t', 'text')} AS d, row_number() OVER (PARTITION BY g ORDER BY 0.55 * ({_LD('t', 'text')}) + 0.45 * ({_LD('t', 'text')}), candidate_id) AS r FROM p JOIN c ON c.group_id = g),
      m AS (SELECT *, t <> text AS ch, 0.50 * ac + 0.28 * mo + 0.22 * co AS j, least(1.0, 0.76 + CASE WHEN t <> text THEN 0.10 ELSE 0 END) AS need FROM n WHERE r = 1),
      h AS (SELECT *, NOT cal OR ac < 0.72 OR co < 0.82 OR mo < 0.75 OR d > 0.55 OR d > 0.50 AS hard FROM m)
      SELECT g AS group_id, candidate_id AS nearest_id, round(j, 7)::DOUBLE AS joint, round(d, 7) AS surface_distance, ch AS critical_change, CASE WHEN hard THEN 'rejected' WHEN j >= need THEN 'accepted-candidate' WHEN j >= need - 0.08 THEN 'provisional-candidate' ELSE 'rejected' END AS decision,
        concat_ws(',', CASE WHEN NOT cal THEN 'uncalibrated-acoustic-verifier' END, CASE WHEN ac < 0.72 THEN 'low-acoustic-compatibility' END, CASE WHEN co < 0.82 THEN 'low-alignment-coverage' END, CASE WHEN mo < 0.75 THEN 'low-mora-compatibility' END, CASE WHEN j < need THEN 'low-joint-verification' END,
        CASE WHEN d > 0.55 THEN 'excessive-surface-distance' END, CASE WHEN d > 0.50 THEN 'excessive-mora-distance' END, CASE WHEN ch THEN 'meaning-critical-change' END) AS reasons FROM h""",
    "phone_policy": """WITH r AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_returnflag || 'bcdef' || l_linestatus AS t, l_partkey % 2 AS ph, l_discount AS p, l_tax AS l FROM lineitem),
      b AS (SELECT * FROM r WHERE i = 1), x AS (SELECT r.*, b.t AS bt, b.ph AS bph, r.p - b.p + 0.5 * (r.l - b.l) AS gain, r.p - b.p >= -1e-12 AND r.l - b.l >= -1e-12 AND levenshtein(b.t, r.t) / greatest(1, length(b.t))::DOUBLE <= 0.35 AS fine FROM r JOIN b USING (g)),
      y AS (SELECT *, CASE WHEN fine AND i > 1 AND gain > 0.005 + 1e-12 THEN gain END AS k FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k DESC NULLS LAST, i = 1 DESC, printf('c%02d', i)) AS n FROM y)
      SELECT g AS group_id, CASE WHEN k IS NULL THEN 'c01' ELSE printf('c%02d', i) END AS selected_id, CASE WHEN k IS NULL THEN bt ELSE t END AS selected_text, k IS NOT NULL AND t <> bt AS changed, CASE WHEN k IS NULL OR t = bt THEN 'retained-first-pass' WHEN ph = bph THEN 'context-resolved-homophone' ELSE 'phone-context-preference' END AS reason FROM z WHERE n = 1""",
    "fallback_guard": """WITH r AS (SELECT p_partkey AS k, p_partkey % 7 = 0 AS none, p_size / 50.0::DOUBLE AS bp, (p_partkey % 50) / 50.0::DOUBLE AS pp, p_retailprice % 7 AS bl, p_retailprice % 5 AS pl, p_partkey % 3 = 0 AS same FROM part),
      x AS (SELECT *, bp < 0.2 AS poor, NOT (bp < 0.2) AND pp - bp < -1e-12 AS ac FROM r), y AS (SELECT *, ac AND pp - bp + 0.1 * (pl - bl) < -1e-12 AS veto, same AND pl - bl < -1e-12 AS sp FROM x)
      SELECT k AS p_partkey, none OR veto OR sp AS veto, CASE WHEN none THEN 'decoder-score-unavailable' WHEN veto THEN 'decoder-phone-regression' WHEN sp THEN 'decoder-same-phone-language-regression' WHEN poor THEN 'decoder-unresolved-low-baseline-fit' WHEN ac THEN 'decoder-unresolved-phone-language-conflict' ELSE 'decoder-not-vetoed' END AS reason FROM y""",
    "teacher_agreement": f"""WITH {_J}, u AS (SELECT g, c, 'a' AS t, l_discount + 0.01 AS m FROM j UNION ALL SELECT g, c, 'b', exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY g)) FROM j UNION ALL SELECT g, c, 'c', l_tax + 0.02 FROM j WHERE g % 4 <> 0),
      p AS (SELECT *, m / sum(m) OVER (PARTITION BY g, t) AS p FROM u), q AS (SELECT *, avg(p) OVER (PARTITION BY g, c) AS x FROM p), s AS (SELECT g, sum(CASE WHEN p > 0 THEN p * ln((p + 1e-12) / (x + 1e-12)) ELSE 0 END) AS kl, count(DISTINCT t) AS active, count(DISTINCT c) AS n FROM q GROUP BY g),
      d AS (SELECT *, least(1.0, greatest(0.0, kl / active / ln(greatest(n, 2)))) AS v FROM s) SELECT g AS group_id, round(v, 7) AS disagreement, active, NOT v > 0.42 AS usable, CASE WHEN v > 0.42 THEN 'teacher-disagreement' ELSE '' END AS reasons FROM d""",
    "decoupled_top_k": f"""WITH {_J}, e AS (SELECT g, c, l_discount * 20 AS t, exp(l_discount * 20 - max(l_discount * 20) OVER w) AS a, exp(l_tax * 20 - max(l_tax * 20) OVER w) AS b FROM j WINDOW w AS (PARTITION BY g)),
      p AS (SELECT *, a / sum(a) OVER (PARTITION BY g) AS tp, b / sum(b) OVER (PARTITION BY g) AS sp, row_number() OVER (PARTITION BY g ORDER BY t DESC, c) <= 2 AS k FROM e), q AS (SELECT *, sum(CASE WHEN k THEN tp ELSE 0 END) OVER (PARTITION BY g) AS tt, sum(CASE WHEN k THEN sp ELSE 0 END) OVER (PARTITION BY g) AS uu FROM p),
      o AS (SELECT g, max(tt) AS tt, max(uu) AS uu, sum(CASE WHEN k THEN tp / tt * ln((tp / tt + 1e-12) / (sp / uu + 1e-12)) ELSE 0 END) AS i FROM q GROUP BY g),
      z AS (SELECT *, tt * ln((tt + 1e-12) / (uu + 1e-12)) + CASE WHEN 1 - tt > 0 THEN (1 - tt) * ln((1 - tt + 1e-12) / (greatest(0, 1 - uu) + 1e-12)) ELSE 0 END AS m FROM o)
      SELECT g AS group_id, round(m, 7) + 0.0 AS mass_kl, round(i, 7) + 0.0 AS inner_kl, round(m + tt * i, 7) + 0.0 AS loss FROM z""",
    "guarded_scores": f"WITH {CANDIDATES}, e AS (SELECT group_id, candidate_id, lexical * 2 AS r, exp(lexical * 2 - max(lexical * 2) OVER w) AS a, exp(greatest(-80, (mora - max(mora) OVER w) / 0.2)) AS b FROM c WINDOW w AS (PARTITION BY group_id)) SELECT group_id, candidate_id, round(r - 6.0 * greatest(0, a / sum(a) OVER w - b / sum(b) OVER w - 0.08), 7) AS guarded FROM e WINDOW w AS (PARTITION BY group_id)",
    "deployment_gate": """WITH s AS (SELECT l_suppkey AS k, round(avg(l_discount), 9) AS d, round(avg(l_tax), 9) AS t, round(avg(l_quantity), 9) AS q FROM lineitem GROUP BY 1), r AS (SELECT k, concat_ws(',', CASE WHEN k % 5 = 0 THEN 'missing-calibration-digest' END, CASE WHEN d - (t + 0.01) > 0.005 + 1e-12 THEN 'top1-accuracy-regression' END, CASE WHEN d - (t + 0.01) > 0.010 + 1e-12 THEN 'pairwise-accuracy-regression' END,
        CASE WHEN t + 0.01 - d > 0.010 + 1e-12 THEN 'semantic-loss-regression' END, CASE WHEN t + 0.01 - d > 1e-12 THEN 'critical-error-regression' END, CASE WHEN t + 0.01 - d > 0.010 + 1e-12 THEN 'calibration-regression' END, CASE WHEN t + 0.01 - d > 0.010 + 1e-12 THEN 'aurc-regression' END,
        CASE WHEN 25.0 / q > 1.05 + 1e-12 THEN 'runtime-slower-than-policy' END, CASE WHEN 25.0 / q > 1.05 + 1e-12 THEN 'memory-regression' END, CASE WHEN 25.0 / q > 1.0 + 1e-12 THEN 'artifact-size-regression' END, CASE WHEN 1.0::DOUBLE - (k % 3) / 1000.0::DOUBLE < 0.999 THEN 'deterministic-replay-regression' END) AS reasons FROM s) SELECT k AS l_suppkey, reasons = '' AS accepted, reasons FROM r""",
    "subtitles_srt": """WITH c AS (SELECT conv_id AS r, turn AS i, turn * 28345 AS a, turn * 28345 + 27001 AS b, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
      f AS (SELECT *, printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) AS x, printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS y FROM c) SELECT r AS recording, i AS "index", md5(n || chr(10) || x || ' --> ' || y || chr(10) || t || chr(10)) AS block_md5 FROM f""",
    "cache_upsert": "SELECT o_custkey % 700 AS key, max(epoch_us(o_orderdate) // 1000000) AS newest FROM orders GROUP BY 1",
}
