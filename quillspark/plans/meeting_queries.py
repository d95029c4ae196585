"""Meetings, documents, digests and prompts over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import canonical as J
from quillspark.operators import context, distil, evaluate, gates, meeting
from quillspark.plans.evidence import table
from quillspark.plans.measure_queries import R
from quillspark.sources import sinks


def _spans(spark, sf):
    """Ten events a span; of every 41 events one has no sample, of every 37 one a short digest."""
    e = table(spark, sf, "events")
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    rows = e.select(
        (F.col("event_id") % 50).alias("meeting_id"), F.concat(F.lit("s"), (F.col("event_id") - F.col("event_id") % 7 % 2).cast("string")).alias("span_id"), (F.col("event_id") * 100).alias("start_ms"), F.lit(16_000).alias("sample_rate"),
        F.when(F.col("event_id") % 41 == 0, F.lit(0)).otherwise(F.col("event_id") % 997 * 11 + 40).alias("sample_count"), F.when(F.col("event_id") % 37 == 0, F.lit("ab")).otherwise(digest).alias("audio_sha256"), digest.alias("recording_sha256"),
        (F.col("event_id") % 5 == 0).alias("aec_applied"), F.when(F.col("event_id") % 3 != 0, F.lit("d")).alias("aec_digest"),
    )
    return meeting.channel_spans(rows)


def meeting_spans(spark, sf):
    s = _spans(spark, sf)
    return s.select("start_ms", "span_id", "end_ms", meeting.span_problem().alias("problem"))


def _told(spark, sf):
    c = table(spark, sf, "conversations")
    said = c.select("conv_id", "turn", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("span_id"), "text", F.coalesce("role", F.lit("none")).alias("writer"), F.when(F.col("turn") % 2 == 0, F.lit("r1")).alias("revision"), F.sha2(F.col("conv_id").cast("string"), 256).alias("evidence"))
    return [meeting.events(said.where(F.col("turn") % 3 == i), a) for i, a in enumerate((meeting.LIVE, meeting.OBSERVED, meeting.NORMALISED))]


def meeting_events(spark, sf):
    a, b, c = _told(spark, sf)
    return a.unionByName(b).unionByName(c).select("conv_id", "turn", "authority", "event_id")


def meeting_problems(spark, sf):
    e = table(spark, sf, "events")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    told = e.select(
        (F.col("event_id") % 50).alias("meeting_id"), F.concat(F.lit("e"), (F.col("event_id") - F.when(F.col("event_id") % 23 == 0, F.lit(50)).otherwise(F.lit(0))).cast("string")).alias("event_id"), name(F.col("event_id") - F.col("event_id") % 7 % 2).alias("span_id"), F.col("event_type").alias("text"),
        F.element_at(F.array(F.lit(meeting.LIVE), F.lit(meeting.OBSERVED), F.lit(meeting.NORMALISED)), (F.col("event_id") % 3 + 1).cast("int")).alias("authority"), F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 300).cast("string")).alias("evidence"),
    )
    return meeting.problems(_spans(spark, sf), told)


def candidate_digests(spark, sf):
    li = table(spark, sf, "lineitem")
    line = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * 100).cast("long"))
    rows = li.select(F.col("l_orderkey").alias("group_id"), line.alias("candidate_id"), F.concat(F.lit('q"'), F.col("l_returnflag"), F.lit("\\\n"), F.col("l_linestatus")).alias("text"), F.array("l_partkey", "l_suppkey").alias("token_ids"), F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("source"))
    several = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("m")).where("n > 1 and n = m").select("group_id")
    return distil.candidate_digests(rows.join(several, "group_id"))


def prompt_context(spark, sf):
    d = table(spark, sf, "documents")
    of = {"leftContext": J.quoted(F.col("text")), "rightContext": J.quoted(F.col("source")), "entityIds": J.array(F.array(J.quoted(F.col("lang")), J.quoted(F.col("doc_id").cast("string"))))}
    here = {k: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), v) for (k, v), c in zip(of.items(), ("text", "source", "doc_id"))}
    made = context.prompt_context(d, here, most=900)
    return made.select("doc_id", F.length("prompt").cast("long").alias("n"), F.md5(F.encode("prompt", "UTF-8")).alias("digest"))


def boundary_diagnostics(spark, sf):
    li = table(spark, sf, "lineitem")
    seen = lambda c: F.when(F.col("l_partkey") % 3 != 0, c)
    rows = li.select(F.col("l_returnflag").alias("system"), F.col("l_quantity").cast("long").alias("reference_characters"), F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_partkey") % 4 + 1) / F.col("l_quantity")).alias("strict_rate"), seen(F.col("l_partkey") % 3).alias("edits"), seen(F.col("l_suppkey") % 4 % 2).alias("prefix"), seen(F.col("l_suppkey") % 6 % 4).alias("suffix"))
    out = evaluate.boundary_diagnostics(rows)
    return out.select("system", R("aligned_rate"), *[c for c in out.columns if c not in ("system", "aligned_rate")])


def transcript_documents(spark, sf):
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null").withColumn("text", F.coalesce("text", F.lit("")))
    segments = c.select(F.col("conv_id").alias("recording"), F.col("turn").alias("index"), (F.col("turn") * 28_345).alias("start_ms"), (F.col("turn") * 28_345 + 27_001).alias("end_ms"), "text", F.coalesce("role", F.lit("-")).alias("decision"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    whole = c.groupBy(F.col("conv_id").alias("recording")).agg(F.count("*").alias("n")).select("recording", F.concat(F.lit("c"), F.col("recording").cast("string")).alias("name"), F.lit("x").alias("audio_sha256"), F.lit("y").alias("evidence_sha256"), (F.col("n") * 1_250).alias("duration_ms"), F.col("n").alias("provisional"), F.lit("o").alias("observed"), F.lit("n").alias("normalized"))
    return sinks.documents(whole, segments).select("recording", "format", F.md5(F.encode("document", "UTF-8")).alias("document_md5"))


def cache_keys(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", sinks.cache_key({"text": F.col("text"), "language": F.col("lang"), "beam": F.lit(8), "source": F.col("source")}).alias("key"))


def policy_choice(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    policies = s.where("s_suppkey <= 40").select(F.format_string("p%02d", "s_suppkey").alias("policy_id"), (F.col("s_suppkey") % 9).cast("int").alias("candidate_count"), (F.col("s_suppkey") % 4 != 0).alias("passed"), (F.col("s_suppkey") == 7).alias("fallback"), (F.col("s_suppkey") * 37 % 101 * 10.0).alias("mean_cost"), F.lit(0.5).alias("upper"), (F.col("s_suppkey") * 37 % 101 * 12.0 + 100).alias("maximum_cost"))
    return gates.select_policy(policies, c.select(F.col("c_custkey").alias("state_id"), (F.col("c_custkey") % 10).alias("available"), (F.col("c_custkey") * 13 % 900).cast("double").alias("budget")))


QUERIES = {f.__name__: f for f in (meeting_spans, meeting_events, meeting_problems, candidate_digests, prompt_context, boundary_diagnostics, transcript_documents, cache_keys, policy_choice)}

_SPANS = """SELECT event_id % 50 AS meeting_id, 's' || (event_id - event_id % 7 % 2) AS span_id, event_id * 100 AS start_ms, CASE WHEN event_id % 41 <> 0 THEN event_id * 100 + round_even((event_id % 997 * 11 + 40) / 16000 * 1000, 0)::BIGINT END AS end_ms,
  CASE WHEN event_id % 41 = 0 OR round_even((event_id % 997 * 11 + 40) / 16000 * 1000, 0) < 1 THEN 'invalid-interval' WHEN event_id % 37 = 0 THEN 'audio-digest' WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 'echo-cancelling-without-provenance' END AS problem FROM events"""
_Q = lambda x: f"coalesce(to_json({x})::VARCHAR, 'null')"
_CLOCK = lambda x, m: f"printf('%02d:%02d:%02d{m}%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"
SQL = {
    "meeting_spans": f"SELECT start_ms, span_id, end_ms, problem FROM ({_SPANS})",
    "meeting_events": f"""WITH t AS (SELECT conv_id, turn, {_Q("'s' || turn")} AS s, {_Q("text")} AS x, {_Q("coalesce(role, 'none')")} AS w, CASE WHEN turn % 2 = 0 THEN '"r1"' ELSE 'null' END AS r, '"' || sha256(conv_id::VARCHAR) || '"' AS e, turn % 3 AS k FROM conversations),
      j AS (SELECT conv_id, turn, CASE k WHEN 0 THEN 'live-provisional' WHEN 1 THEN 'final-observed' ELSE 'normalized-derivative' END AS authority, CASE k WHEN 0 THEN 'live-' WHEN 1 THEN 'observed-' ELSE 'normalized-' END AS prefix,
        CASE k WHEN 0 THEN '{{"authority": "live-provisional", "backend": ' || w || ', "revision": ' || r
          WHEN 1 THEN '{{"authority": "final-observed", "backend": ' || w || ', "evidenceDigest": ' || e || ', "revision": ' || r
          ELSE '{{"authority": "normalized-derivative", "normalizer": ' || w || ', "observedEvidenceDigest": ' || e || ', "revision": ' || r END || ', "spanId": ' || s || ', "text": ' || x || '}}' AS j FROM t WHERE k IS NOT NULL)
      SELECT conv_id, turn, authority, prefix || substr(sha256(j), 1, 16) AS event_id FROM j""",
    "meeting_problems": f"""WITH s AS ({_SPANS}), t AS (SELECT event_id % 50 AS m, 'e' || (event_id - CASE WHEN event_id % 23 = 0 THEN 50 ELSE 0 END) AS id, 's' || (event_id - event_id % 7 % 2) AS sp, event_type AS x, event_id % 3 AS k, CASE WHEN event_id % 11 <> 0 THEN (event_id % 300)::VARCHAR END AS ev FROM events)
      SELECT meeting_id, span_id AS id, problem FROM s WHERE problem IS NOT NULL
      UNION ALL SELECT m, id, CASE WHEN coalesce(x, '') = '' THEN 'event-incomplete' WHEN k = 0 AND ev IS NOT NULL THEN 'live-claims-evidence' WHEN k = 1 AND ev IS NULL THEN 'observed-without-evidence' END AS p FROM t WHERE p IS NOT NULL
      UNION ALL SELECT meeting_id, span_id, 'span-repeated' FROM s GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT m, id, 'event-repeated' FROM t GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT m, id, 'unknown-span' FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.meeting_id = t.m AND s.span_id = t.sp)
      UNION ALL SELECT m, id, 'unknown-evidence' FROM t WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM t o WHERE o.k = 1 AND o.m = t.m AND o.ev = t.ev)""",
    "candidate_digests": """WITH r AS (SELECT l_orderkey AS g, concat_ws('-', l_linenumber, l_partkey, l_suppkey, trunc(l_extendedprice * 100)::BIGINT) AS c, l_partkey AS p, l_suppkey AS s, 'q"' || l_returnflag || chr(92) || chr(10) || l_linestatus AS t, CASE WHEN l_tax > 0.01 THEN l_returnflag END AS src FROM lineitem),
      j AS (SELECT g, c, '{"candidateId":"' || c || '","source":' || coalesce(to_json(src)::VARCHAR, 'null') || ',"text":' || to_json(t)::VARCHAR || ',"tokenIds":[' || p || ',' || s || ']}' AS j FROM r)
      SELECT g AS group_id, sha256('[' || string_agg(j, ',' ORDER BY c) || ']') AS digest FROM j GROUP BY g HAVING count(*) > 1 AND count(*) = count(DISTINCT c)""",
    "prompt_context": f"""WITH d AS (SELECT doc_id, '{{"format":"document-context-v2","sections":[' || concat_ws(',', CASE WHEN text <> '' THEN '["leftContext",' || to_json(text)::VARCHAR || ']' END, CASE WHEN source <> '' THEN '["rightContext",' || to_json(source)::VARCHAR || ']' END, CASE WHEN doc_id IS NOT NULL THEN '["entityIds",[' || {_Q("lang")} || ',"' || doc_id || '"]]' END) || ']}}' AS w FROM documents),
      h AS (SELECT *, '"format":"document-context-v2","fullContextSha256":"' || sha256('{{"fullContext":' || to_json(w)::VARCHAR || '}}') || '","truncated":true}}' AS e FROM d),
      m AS (SELECT *, 900 - length('{{"contextPrefix":"",' || e) AS room FROM h),
      p AS (SELECT *, CASE WHEN length(w) > 900 THEN list_max(list_filter(range(0, 901), lambda n: length(to_json(w[1:n])::VARCHAR) - 2 <= room)) END AS n FROM m),
      o AS (SELECT doc_id, CASE WHEN n IS NULL THEN w ELSE '{{"contextPrefix":' || to_json(substr(w, 1, n))::VARCHAR || ',' || e END AS made FROM p)
      SELECT doc_id, length(made) AS n, md5(made) AS digest FROM o""",
    "boundary_diagnostics": """WITH r AS (SELECT l_returnflag AS system, l_quantity::BIGINT AS n, CASE WHEN l_suppkey % 5 <> 0 THEN (l_partkey % 4 + 1) / l_quantity END AS rate, l_partkey % 3 AS e, l_suppkey % 4 % 2 AS p, l_suppkey % 6 % 4 AS s, l_partkey % 3 <> 0 AS al FROM lineitem)
      SELECT system, round(sum(e) FILTER (al) / sum(n) FILTER (al), 7) AS aligned_rate, greatest(0, round_even(sum(rate * n), 0)::BIGINT - sum(e) FILTER (al))::BIGINT AS edit_reduction, count(*) FILTER (al AND (p > 0 OR s > 0)) AS overrun_rows, count(*) FILTER (al AND p > 0) AS prefix_rows, (sum(p) FILTER (al))::BIGINT AS prefix_characters, count(*) FILTER (al AND s > 0) AS suffix_rows, (sum(s) FILTER (al))::BIGINT AS suffix_characters FROM r GROUP BY system""",
    "transcript_documents": f"""WITH c AS (SELECT conv_id AS r, turn AS i, {_CLOCK('(turn * 28345)', ',')} || ' --> ' || {_CLOCK('(turn * 28345 + 27001)', ',')} AS a, {_CLOCK('(turn * 28345)', '.')} || ' --> ' || {_CLOCK('(turn * 28345 + 27001)', '.')} AS b, {_CLOCK('(turn * 28345)', '.')} AS st, coalesce(text, '') AS t, coalesce(role, '-') AS ro, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
      g AS (SELECT r, count(*) AS k, string_agg(n || chr(10) || a || chr(10) || t || chr(10), chr(10) ORDER BY i) AS srt, string_agg(b || chr(10) || t || chr(10), chr(10) ORDER BY i) AS vtt, string_agg('- `' || st || '` [' || ro || '] ' || t || CASE WHEN i % 3 = 0 THEN ' ' || chr(9888) || chr(65039) || ' `a, b`' ELSE '' END, chr(10) ORDER BY i) AS tl FROM c GROUP BY r),
      d AS (SELECT r, unnest(['srt', 'vtt', 'md', 'observed.txt', 'normalized.txt']) AS f, unnest([srt, 'WEBVTT' || chr(10) || chr(10) || vtt, rtrim(replace(printf('# c%d||- Audio SHA-256: `x`|- Evidence SHA-256: `y`|- Duration: `%.3f` seconds|- Provisional windows: `%d`||## Observed transcript||o||## Normalized transcript||n||## Timeline||', r, k * 1.25::DOUBLE, k), '|', chr(10)) || tl, ' ' || chr(10)) || chr(10), 'o' || chr(10), 'n' || chr(10)]) AS t FROM g)
      SELECT r AS recording, f AS format, md5(t) AS document_md5 FROM d""",
    "cache_keys": f"""SELECT doc_id, sha256('{{"beam":"8","language":' || {_Q("lang")} || ',"source":' || {_Q("source")} || ',"text":' || {_Q("text")} || '}}') AS key FROM documents""",
    "policy_choice": """WITH p AS (SELECT printf('p%02d', s_suppkey) AS id, s_suppkey % 9 AS n, s_suppkey % 4 <> 0 AS ok, s_suppkey = 7 AS fb, s_suppkey * 37 % 101 * 10.0 AS c, s_suppkey * 37 % 101 * 12.0 + 100 AS m FROM supplier WHERE s_suppkey <= 40),
      b AS (SELECT c_custkey AS s, p.*, ok AND c_custkey % 10 >= n AND m <= c_custkey * 13 % 900 AND c <= c_custkey * 13 % 900 AS fit FROM customer, p)
      SELECT s AS state_id, id AS policy_id, fit AS eligible FROM b WHERE fb OR fit QUALIFY row_number() OVER (PARTITION BY s ORDER BY fit DESC, c, n, id) = 1""",
}
