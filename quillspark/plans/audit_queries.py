"""Lineage, rights, intervals and runs over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import enrich, intervals, lineage
from quillspark.plans.evidence import table

R = lambda c: F.round(c, 7).alias(c)
L = lambda c: F.col(c).cast("long").alias(c)


def records(spark, sf):
    o = table(spark, sf, "orders")
    near = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("near-"), F.col("o_orderkey") % 97))
    parents = F.array_compact(F.array(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1), F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") + 100_000_000)))
    return o.select(
        F.col("o_orderkey").alias("sample_id"), lineage.assign_split(F.col("o_custkey") % 5000 + F.col("o_orderkey") % 3, "42").alias("split"), F.col("o_custkey").cast("string").alias("speaker_id"),
        F.concat_ws("-", F.col("o_custkey"), F.date_format("o_orderdate", "yyyyMM")).alias("session_id"), near.alias("near_duplicate_id"), F.concat(F.lit("asset-"), F.col("o_custkey") % 20).alias("rights_asset_id"),
        F.when(F.col("o_orderkey") % 13 != 0, F.lit("pcm")).alias("has_pcm"), parents.alias("parent_sample_ids"),
    )


RECORDS = """
rec AS (SELECT o_orderkey AS sample_id, CASE WHEN b / 255.0 < 0.6 THEN 'train' WHEN b / 255.0 < 0.8 THEN 'calibration' ELSE 'test' END AS split, o_custkey::VARCHAR AS speaker_id,
    concat_ws('-', o_custkey, strftime(o_orderdate, '%Y%m')) AS session_id, CASE WHEN o_orderkey % 11 = 0 THEN 'near-' || (o_orderkey % 97) END AS near_duplicate_id, 'asset-' || (o_custkey % 20) AS rights_asset_id,
    CASE WHEN o_orderkey % 13 <> 0 THEN 'pcm' END AS has_pcm, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 100000000 END], lambda x: x IS NOT NULL) AS parents
  FROM (SELECT *, ('0x' || sha256('42:' || (o_custkey % 5000 + o_orderkey % 3))[1:2])::INTEGER AS b FROM orders))"""


def split_assign_hash(spark, sf):
    return records(spark, sf).select("sample_id", "split")


def split_leakage(spark, sf):
    out = lineage.leakage(records(spark, sf))
    return out.select("kind", "value", F.array_join("splits", ",").alias("splits"), F.size("sample_ids").cast("long").alias("samples"), F.array_min("sample_ids").alias("first_sample"))


def missing_parents(spark, sf):
    return lineage.missing_parents(records(spark, sf))


def parent_cycles(spark, sf):
    # Suppliers of one nation, each the parent of the next by account, and every third nation closed to a ring.
    s = table(spark, sf, "supplier").withColumn("i", F.expr("row_number() over (partition by s_nationkey order by s_suppkey)")).withColumn("n", F.expr("count(*) over (partition by s_nationkey)")).withColumn("next", F.expr("lead(s_suppkey) over (partition by s_nationkey order by s_suppkey)")).withColumn("first", F.expr("min(s_suppkey) over (partition by s_nationkey)"))
    parent = F.coalesce("next", F.when(F.col("s_nationkey") % 3 == 0, F.col("first")))
    return lineage.cyclic_samples(s.select(F.col("s_suppkey").alias("sample_id"), F.array_compact(F.array(parent)).alias("parent_sample_ids")))


def integrity_report(spark, sf):
    return lineage.integrity(records(spark, sf).withColumnRenamed("has_pcm", "pcm_sha256"))


def rights_gate(spark, sf):
    asset = F.concat(F.lit("asset-"), F.col("n_nationkey"))
    registry = table(spark, sf, "nation").where("n_nationkey < 18").select(asset.alias("asset_id"), F.element_at(F.array(F.lit("allow"), F.lit("deny"), F.lit("review")), F.col("n_nationkey") % 3 + 1).alias("training"))
    return lineage.denied(records(spark, sf), registry, "training").groupBy("rights_asset_id", "state").agg(F.count("*").alias("n"))


def _millis(c: str):
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def _spans(spark, sf):
    e = table(spark, sf, "events")
    start = _millis("ts")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), start.alias("start"), (start + F.round(F.col("value") * 200_000).cast("long")).alias("end"))


_SPANS = "sp AS (SELECT user_id AS key, event_id AS id, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + round(value * 200000)::BIGINT AS e FROM events)"


def interval_coalesce(spark, sf):
    return intervals.coalesce_intervals(_spans(spark, sf), ["key"], "start", "end", gap=3_600_000)


def interval_overlap_join(spark, sf):
    s = _spans(spark, sf)
    return intervals.overlap_join(s, s, "key", width=86_400_000).where("l_id < r_id")


def coverage_attribution(spark, sf):
    out = intervals.coverage_attribution(_spans(spark, sf), "key")
    return out.select("key", "id", F.round("attributed", 4).alias("attributed"))


def window_plan(spark, sf):
    rec = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recording"), F.floor(F.col("o_totalprice")).cast("long").alias("duration_ms"))
    return intervals.plan_windows(rec).select("recording", L("index"), "start_ms", "end_ms")


def rle_collapse(spark, sf):
    out = intervals.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("user_id", L("run"), "event_type", L("first"), "length")


def sessionize_gap(spark, sf):
    e = table(spark, sf, "events").withColumn("at", _millis("ts"))
    return intervals.islands(e, ["user_id"], "at", gap=6 * 3_600_000).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), (F.max("at") - F.min("at")).alias("span"))


def grouped_refine_batch(spark, sf):
    f = _spans(spark, sf)
    w = F.expr("lead(start) over (partition by key order by start)")
    finals = f.withColumn("next", w).select(F.col("key").alias("session"), "id", "start", F.least(F.col("end"), F.coalesce("next", "end")).alias("end")).where("end > start")
    out = intervals.grouped_finals(finals, idle=6 * 3_600_000, longest=3 * 86_400_000, most=8)
    return out.select("session", L("group"), "first", "last", "start", "end", L("parents"), "trigger")


def context_frames(spark, sf):
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    out = intervals.context_frames(c, ["conv_id"], "turn", "text", characters=200)
    return out.select("conv_id", "turn", F.md5(F.encode("left_context", "UTF-8")).alias("left_md5"), F.md5(F.encode("right_context", "UTF-8")).alias("right_md5"))


def throttle_hysteresis(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.least(F.lit(1.0), F.col("value") / 200.0).alias("pressure"))
    return intervals.throttle(e, "user_id", "event_id", "pressure").select("user_id", "event_id", L("level"), L("stable"))


def pmi_transitions(spark, sf):
    li = table(spark, sf, "lineitem")
    base = li.select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"), F.col("l_partkey") % 3, F.col("l_suppkey") % 3, F.col("l_quantity").alias("q")).toDF("doc", "candidate_id", "a0", "a1", "q").dropDuplicates(["doc", "candidate_id"])
    p = base.withColumn("p", F.col("q") / F.expr("sum(q) over (partition by doc)")).select("doc", "candidate_id", "p")
    arcs = base.select("doc", "candidate_id", F.explode(F.array(F.struct(F.lit(0).alias("span"), F.col("a0").alias("arc")), F.struct(F.lit(1).alias("span"), F.col("a1").alias("arc")))).alias("x")).select("doc", "x.span", "x.arc", "candidate_id")
    return enrich.transition_pmi(arcs, p).select("doc", "left_arc", "right_arc", R("value"))


QUERIES = {f.__name__: f for f in (split_assign_hash, split_leakage, missing_parents, parent_cycles, integrity_report, rights_gate, interval_coalesce, interval_overlap_join, coverage_attribution, window_plan, rle_collapse, sessionize_gap, grouped_refine_batch, context_frames, throttle_hysteresis, pmi_transitions)}
SQL = {
    "split_assign_hash": f"WITH {RECORDS} SELECT sample_id, split FROM rec",
    "split_leakage": f"""WITH {RECORDS}, v AS (SELECT 'speaker-id' AS kind, speaker_id AS value, sample_id, split FROM rec UNION ALL SELECT 'session-id', session_id, sample_id, split FROM rec UNION ALL SELECT 'near-duplicate-id', near_duplicate_id, sample_id, split FROM rec WHERE near_duplicate_id IS NOT NULL)
      SELECT kind, value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT sample_id) AS samples, min(sample_id) AS first_sample FROM v GROUP BY kind, value HAVING count(DISTINCT split) > 1
      UNION ALL SELECT 'parent-sample-id', p.sample_id::VARCHAR, array_to_string(list_sort([c.split, p.split]), ','), 2, least(c.sample_id, p.sample_id) FROM (SELECT sample_id, split, unnest(parents) AS parent FROM rec) c JOIN rec p ON p.sample_id = c.parent WHERE c.split <> p.split""",
    "missing_parents": f"WITH {RECORDS}, e AS (SELECT sample_id, unnest(parents) AS parent_id FROM rec) SELECT sample_id, parent_id FROM e WHERE parent_id NOT IN (SELECT sample_id FROM rec)",
    "parent_cycles": "SELECT s_suppkey AS sample_id FROM supplier WHERE s_nationkey % 3 = 0",
    "integrity_report": f"WITH {RECORDS} SELECT count(*) AS records, count(*) FILTER (WHERE split = 'train') AS train_records, count(*) FILTER (WHERE split = 'calibration') AS calibration_records, count(*) FILTER (WHERE split = 'test') AS test_records, count(*) FILTER (WHERE speaker_id IS NULL) AS unknown_speaker, count(*) FILTER (WHERE has_pcm IS NULL) AS missing_pcm, count(*) FILTER (WHERE rights_asset_id IS NULL) AS unknown_rights, count(DISTINCT sample_id) AS samples FROM rec",
    "rights_gate": f"WITH {RECORDS}, g AS (SELECT 'asset-' || n_nationkey AS a, ['allow', 'deny', 'review'][n_nationkey % 3 + 1] AS s FROM nation WHERE n_nationkey < 18) SELECT rights_asset_id, coalesce(s, 'unknown') AS state, count(*) AS n FROM rec LEFT JOIN g ON a = rights_asset_id WHERE coalesce(s, 'unknown') <> 'allow' GROUP BY ALL",
    "interval_coalesce": f"WITH {_SPANS}, a AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM sp), b AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT key, min(s) AS start, max(e) AS \"end\", count(*) AS members FROM b GROUP BY key, run",
    "interval_overlap_join": f"WITH {_SPANS} SELECT a.key, a.id AS l_id, b.id AS r_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS \"end\" FROM sp a JOIN sp b ON a.key = b.key AND a.id < b.id AND least(a.e, b.e) > greatest(a.s, b.s)",
    "coverage_attribution": f"WITH {_SPANS}, x AS (SELECT DISTINCT key, t FROM (SELECT key, s AS t FROM sp WHERE e > s UNION ALL SELECT key, e FROM sp WHERE e > s)), y AS (SELECT key, t AS a, lead(t) OVER (PARTITION BY key ORDER BY t) AS b FROM x), z AS (SELECT y.key, sp.id, (b - a) / (count(*) OVER (PARTITION BY y.key, a))::DOUBLE AS v FROM y JOIN sp ON sp.key = y.key AND sp.s < b AND sp.e > a WHERE b IS NOT NULL) SELECT key, id, round(sum(v), 4) AS attributed FROM z GROUP BY ALL",
    "window_plan": "WITH d AS (SELECT o_orderkey AS recording, floor(o_totalprice)::BIGINT AS ms FROM orders), w AS (SELECT recording, ms, unnest(range(0, greatest(0, ceil((ms - 28000) / 26800.0))::BIGINT + 1)) AS i FROM d WHERE ms > 0) SELECT recording, i AS \"index\", i * 26800 AS start_ms, least(ms, i * 26800 + 28000) AS end_ms FROM w",
    "rle_collapse": "WITH a AS (SELECT user_id, event_type, row_number() OVER o AS i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS run FROM a) SELECT user_id, run::BIGINT AS run, max(event_type) AS event_type, min(i) AS \"first\", count(*) AS length FROM b GROUP BY user_id, run",
    "sessionize_gap": "WITH a AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000 THEN 1 ELSE 0 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS island FROM a) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first_event, max(t) - min(t) AS span FROM b GROUP BY user_id, island",
    "context_frames": "WITH a AS (SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), '') AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) SELECT conv_id, turn, md5(right(l, 200)) AS left_md5, md5(left(r, 200)) AS right_md5 FROM a",
    "pmi_transitions": """WITH b AS (SELECT DISTINCT ON (l_orderkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey)) l_orderkey AS doc, l_partkey % 3 AS a0, l_suppkey % 3 AS a1, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS c, l_quantity AS q FROM lineitem),
      p AS (SELECT *, q / sum(q) OVER (PARTITION BY doc) AS p FROM b), l AS (SELECT doc, a0, sum(p) AS m FROM p GROUP BY ALL), r AS (SELECT doc, a1, sum(p) AS m FROM p GROUP BY ALL), j AS (SELECT doc, a0, a1, sum(p) AS m FROM p GROUP BY ALL)
      SELECT l.doc, l.a0 AS left_arc, r.a1 AS right_arc, round(tanh(ln((coalesce(j.m, 0) + 1e-9) / (l.m * r.m + 1e-9))), 7) + 0.0 AS value FROM l JOIN r ON l.doc = r.doc LEFT JOIN j ON j.doc = l.doc AND j.a0 = l.a0 AND j.a1 = r.a1""",
    "throttle_hysteresis": """WITH RECURSIVE e AS (SELECT user_id, event_id, least(1.0, value / 200.0) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
      s AS (SELECT user_id, 0::BIGINT AS i, 0 AS level, 0 AS stable, NULL::BIGINT AS event_id FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT x.user_id, x.i, CASE WHEN t > s.level THEN t WHEN hold OR s.stable + 1 < 3 THEN s.level ELSE greatest(t, s.level - 1) END, CASE WHEN t > s.level OR hold OR s.stable + 1 >= 3 THEN 0 ELSE s.stable + 1 END, x.event_id
        FROM s JOIN e x ON x.user_id = s.user_id AND x.i = s.i + 1, LATERAL (SELECT CASE WHEN x.p >= 0.78 THEN 3 WHEN x.p >= 0.56 THEN 2 WHEN x.p >= 0.32 THEN 1 ELSE 0 END AS t), LATERAL (SELECT t = s.level OR x.p > greatest(0.0, CASE s.level WHEN 1 THEN 0.32 WHEN 2 THEN 0.56 WHEN 3 THEN 0.78 ELSE 0.0 END - 0.10) AS hold))
      SELECT user_id, event_id, level::BIGINT AS level, stable::BIGINT AS stable FROM s WHERE i > 0""",
    "grouped_refine_batch": """WITH RECURSIVE """ + _SPANS + """, n AS (SELECT key, id, s, least(e, coalesce(lead(s) OVER (PARTITION BY key ORDER BY s), e)) AS e FROM sp), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, e, id::VARCHAR) AS i FROM n WHERE e > s),
      g AS (SELECT key, 1::BIGINT AS i, 1::BIGINT AS grp, s AS gs, e AS pe, 1::BIGINT AS cnt, e - s >= 259200000 AS full_, 'x' AS why FROM f WHERE i = 1
        UNION ALL SELECT f.key, f.i, CASE WHEN fresh THEN g.grp + 1 ELSE g.grp END, CASE WHEN fresh THEN f.s ELSE g.gs END, f.e, CASE WHEN fresh THEN 1 ELSE g.cnt + 1 END, f.e - CASE WHEN fresh THEN f.s ELSE g.gs END >= 259200000,
          CASE WHEN g.full_ THEN 'x' WHEN f.s - g.pe >= 21600000 THEN 'idle-gap' WHEN f.e - g.gs > 259200000 THEN 'max-duration' WHEN g.cnt >= 8 THEN 'parent-limit' ELSE 'x' END
        FROM g JOIN f ON f.key = g.key AND f.i = g.i + 1, LATERAL (SELECT g.full_ OR f.s - g.pe >= 21600000 OR f.e - g.gs > 259200000 OR g.cnt >= 8 AS fresh)),
      h AS (SELECT g.*, f.id, f.s, f.e FROM g JOIN f ON f.key = g.key AND f.i = g.i),
      z AS (SELECT key, grp, arg_min(id, i)::VARCHAR AS "first", arg_max(id, i)::VARCHAR AS "last", min(gs) AS start, arg_max(e, i) AS "end", max(cnt) AS parents, bool_or(full_) AS full_ FROM h GROUP BY key, grp)
      SELECT z.key AS session, z.grp AS "group", z."first", z."last", z.start, z."end", z.parents, CASE WHEN z.full_ THEN 'max-duration' ELSE coalesce((SELECT max(h.why) FROM h WHERE h.key = z.key AND h.grp = z.grp + 1 AND h.cnt = 1), 'eof') END AS trigger FROM z""",
}
