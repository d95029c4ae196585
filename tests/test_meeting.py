import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.functions import canonical as J
from quillspark.operators import context, distil, evaluate, gates, learn, lineage, meeting
from quillspark.sources import sinks

_compact = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical_json_is_that_of_the_standard_library(spark):
    texts = ["", "a\"b\\c/", "\n\t\r\b\f", "\x00\x0b\x1f\x7f", "日本\U00020bb7é ", "[]{}\"", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", J.quoted(F.col("t")).alias("q"), J.record({"b": J.quoted(F.col("t")), "a": F.lit("1")}, spaced=True).alias("r")).collect()
    for r in got:
        assert r.q == json.dumps(r.t, ensure_ascii=False)
        assert r.r == json.dumps({"a": 1, "b": r.t}, ensure_ascii=False, sort_keys=True)


def test_prompts_keep_to_their_limit(spark):
    texts = ["short", "é\"\n" * 60, "x" * 400, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for most in (0, 5, 150, 175, 200, 260, 12_000):
        for r in context.prompt_context(rows, {"leftContext": F.when(F.col("text") != "", J.quoted(F.col("text")))}, most=most).collect():
            whole = _compact({"format": "document-context-v2", "sections": [["leftContext", r.text]] if r.text else []})
            seal = hashlib.sha256(_compact({"fullContext": whole}).encode()).hexdigest()
            ends = {"format": "document-context-v2", "fullContextSha256": seal, "truncated": True}
            fitting = [x for x in (_compact({**ends, "contextPrefix": whole[:n]}) for n in range(len(whole) + 1)) if len(x) <= most]
            want = whole if len(whole) <= most else fitting[-1] if fitting else _compact(ends)[:most]
            assert r.prompt == (want if most else "")


def test_events_and_their_evidence(spark):
    said = spark.createDataFrame([("m", "s1", 'A "quote"', "asr", None, "e1")], "meeting_id string, span_id string, text string, writer string, revision string, evidence string")
    live, seen, clean = (meeting.events(said, a).first() for a in (meeting.LIVE, meeting.OBSERVED, meeting.NORMALISED))
    record = {"spanId": "s1", "text": 'A "quote"', "revision": None}
    for got, more, prefix in ((live, {"backend": "asr", "authority": meeting.LIVE}, "live-"), (seen, {"backend": "asr", "evidenceDigest": "e1", "authority": meeting.OBSERVED}, "observed-"), (clean, {"normalizer": "asr", "observedEvidenceDigest": "e1", "authority": meeting.NORMALISED}, "normalized-")):
        assert got.event_id == prefix + hashlib.sha256(json.dumps(record | more, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]
    ok = hashlib.sha256(b"").hexdigest()
    spans = meeting.channel_spans(spark.createDataFrame([("m", "s1", 0, 16_000, 16_000, ok, ok, False, None)], "meeting_id string, span_id string, start_ms long, sample_rate int, sample_count int, audio_sha256 string, recording_sha256 string, aec_applied boolean, aec_digest string"))
    assert spans.first().end_ms == 1_000
    told = meeting.events(said, meeting.OBSERVED).unionByName(meeting.events(said, meeting.NORMALISED))
    assert meeting.problems(spans, told).count() == 0
    assert meeting.authoritative(told).count() == 1 and meeting.normalised(told).count() == 1
    bad = told.withColumn("span_id", F.lit("s9")).withColumn("evidence", F.when(F.col("authority") == meeting.NORMALISED, F.lit("e2")).otherwise(F.col("evidence")))
    assert sorted(r.problem for r in meeting.problems(spans.union(spans), bad).collect()) == ["span-repeated", "unknown-evidence", "unknown-span", "unknown-span"]
    assert meeting.problems(spans.where("false"), told.where("false")).count() == 0


def test_digests_of_candidate_sets(spark):
    kind = "group_id int, candidate_id string, text string, token_ids array<int>, source string"
    rows = [(1, "b", "y", [], None), (1, "a", "x\"", [1, 2], "s")]
    want = hashlib.sha256(_compact([{"candidateId": c, "text": t, "tokenIds": i, "source": s} for _, c, t, i, s in sorted(rows, key=lambda r: r[1])]).encode()).hexdigest()
    for order in (rows, rows[::-1]):
        assert distil.candidate_digests(spark.createDataFrame(order, kind)).first().digest == want
    with pytest.raises(Exception, match="fewer than two"):
        distil.candidate_digests(spark.createDataFrame(rows[:1], kind)).collect()
    with pytest.raises(Exception, match="repeated"):
        distil.candidate_digests(spark.createDataFrame(rows + rows[:1], kind)).collect()


def test_documents_are_written(spark, tmp_path):
    whole = spark.createDataFrame([(1, "talk", "aa", "ee", 61_500, 2, "seen", "clean"), (2, "none", "bb", "ff", 0, 0, "", "")], "recording int, name string, audio_sha256 string, evidence_sha256 string, duration_ms long, provisional long, observed string, normalized string")
    parts = spark.createDataFrame([(1, 1, 1_500, 2_000, "two", "kept", ["w"]), (1, 0, 0, 1_000, "one", "kept", [])], "recording int, index int, start_ms long, end_ms long, text string, decision string, warnings array<string>")
    made = sinks.documents(whole, parts)
    got = {(r.recording, r.format): r.document for r in made.collect()}
    assert got[1, "srt"] == "1\n00:00:00,000 --> 00:00:01,000\none\n\n2\n00:00:01,500 --> 00:00:02,000\ntwo\n"
    assert got[1, "vtt"].startswith("WEBVTT\n\n00:00:00.000 --> ") and got[2, "vtt"] == "WEBVTT\n\n"
    assert "- Duration: `61.500` seconds" in got[1, "md"] and got[1, "md"].endswith("- `00:00:01.500` [kept] two ⚠️ `w`\n") and got[2, "md"].endswith("## Timeline\n")
    sinks.write_documents(made.where("format = 'md'"), str(tmp_path / "out"))
    folder = tmp_path / "out" / "format=md" / "recording=1"
    text = "".join((folder / f).read_text() for f in os.listdir(folder) if f.endswith(".txt"))
    assert text.rstrip("\n") == got[1, "md"].rstrip("\n")
    with pytest.raises(Exception, match="exists"):
        sinks.write_documents(made, str(tmp_path / "out"))


def test_bounds_are_told(spark):
    rows = spark.createDataFrame([(g, 10, 1, 2) for g in range(20)], "group_id int, reference_units int, baseline_errors int, candidate_errors int")
    with pytest.raises(Exception, match="poisson_bootstrap"):
        evaluate.paired_bootstrap(rows, iterations=2, most_groups=5).collect()
    ring = spark.createDataFrame([(i, [(i + 1) % 12]) for i in range(12)], "sample_id int, parent_sample_ids array<int>")
    assert lineage.cyclic_samples(ring).count() == 12
    with pytest.raises(RuntimeError):
        lineage.cyclic_samples(ring, max_rounds=2)
    kind = "policy_id string, candidate_count int, passed boolean, fallback boolean, mean_cost double, upper double, maximum_cost double"
    policies = spark.createDataFrame([("cheap", 1, True, False, 1.0, 0.1, 10.0), ("dear", 3, True, False, 5.0, 0.1, 20.0), ("last", 3, False, True, 9.0, 0.1, float("inf"))], kind)
    states = spark.createDataFrame([(1, 5, 50.0), (2, 0, 50.0), (3, 5, None)], "state_id int, available int, budget double")
    assert {r.state_id: (r.policy_id, r.eligible) for r in gates.select_policy(policies, states).collect()} == {1: ("cheap", True), 2: ("last", False), 3: ("last", False)}
    assert gates.select_policy(policies.where("not fallback"), states).count() == 1
    with pytest.raises(ValueError, match="policies"):
        gates.select_policy(spark.range(1_001).selectExpr("cast(id as string) policy_id", "1 candidate_count", "true passed", "false fallback", "1D mean_cost", "1D upper", "1D maximum_cost"), states)


def test_isotonic_blocks_do_not_depend_on_partitions(spark):
    rows = spark.range(4_000).selectExpr("pmod(hash(id), 1000) / 1000D score", "pmod(hash(id, 7), 1000) < pmod(hash(id), 1000) correct")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = learn.isotonic(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    many = learn.isotonic(rows)
    assert [x for x, _ in one] == [x for x, _ in many] and [p for _, p in one] == pytest.approx([p for _, p in many])
    assert all(a[1] < b[1] for a, b in zip(one, one[1:]))
