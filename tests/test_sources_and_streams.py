import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lineage
from quillspark.sources import readers, sinks
from quillspark.streaming import sessions


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_benchmark_in_both_cases(spark, tmp_path):
    path = lines(tmp_path / "b.jsonl", [{"sampleId": "1", "split": "test", "candidates": [{"candidateId": "a", "text": "x", "avgLogprob": -1.0}]}, "", {"sample_id": "2", "split": "train", "candidates": [{"candidateId": "b", "text": "y"}]}])
    rows = readers.read_benchmark(spark, path)
    assert {(r.group_id, r.candidate_id, r.avg_logprob) for r in readers.candidate_rows(rows).collect()} == {("1", "a", -1.0), ("2", "b", None)}
    with pytest.raises(Exception, match="unknown split"):
        readers.read_benchmark(spark, lines(tmp_path / "c.jsonl", [{"sampleId": "1", "split": "odd"}])).collect()
    with pytest.raises(Exception):
        readers.read_benchmark(spark, lines(tmp_path / "d.jsonl", ["{broken"])).collect()


def test_guards(spark, tmp_path):
    fine = lines(tmp_path / "r.jsonl", [{"sampleId": "1", "groupId": "g", "k": 1, "loss": 0.5, "costMs": 1.0, "split": "calibration"}])
    assert readers.read_risk(spark, fine).first().cost_ms == 1.0
    for bad in ({"k": 1, "loss": 0.5, "split": "train"}, {"k": 1, "loss": 1.5, "split": "calibration"}):
        with pytest.raises(Exception, match="admitted|losses"):
            readers.read_risk(spark, lines(tmp_path / f"{bad['loss']}.jsonl", [bad])).collect()
    audio = lines(tmp_path / "a.jsonl", [{"sampleId": "1", "rightsDecision": "allow", "datasetName": "x"}])
    with pytest.raises(Exception, match="come together"):
        readers.read_audio_manifest(spark, audio).collect()


def test_second_ear(spark, tmp_path):
    path = lines(tmp_path / "e.jsonl", ["loading model", {"sampleId": "1", "hypotheses": ["old"], "modelRevision": "r"}, {"sample_id": "1", "hypotheses": ["new"], "model_revision": "r"}])
    assert readers.read_second_ear(spark, path).first().texts == ["new"]
    with pytest.raises(ValueError):
        readers.read_second_ear(spark, lines(tmp_path / "f.jsonl", [{"sampleId": "1", "modelRevision": "r"}, {"sampleId": "2", "modelRevision": "s"}]))


def test_catalogue_and_rights(spark, tmp_path):
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"name": "n", "revision": "1", "entries": [{"id": "a", "phrase": "p", "tags": ["t"]}]}, indent=1))
    r = readers.read_catalogue(spark, str(c)).first()
    assert (r.entry_id, r.aliases, r.tags, r.priority) == ("a", [], ["t"], 0.0)
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"records": [{"assetId": "x", "training": "allow"}]}))
    got = readers.read_rights(spark, str(g), lineage.OPERATIONS).first()
    assert got.training == "allow" and got.publication == "deny"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", None), (2, "test", "x")], "id long, split string, v string")
    out = str(tmp_path / "o")
    sinks.partition_by_split(df, out)
    assert spark.read.json(out).where("split = 'test'").count() == 1
    with pytest.raises(Exception):
        sinks.partition_by_split(df, out)
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert any('"v":null' in p.read_text() for p in (tmp_path / "j").glob("part*"))
    rows = spark.createDataFrame([(1, 0, 0, 1_500, "a"), (1, 1, 3_661_001, 3_662_000, "b")], "recording long, index long, start_ms long, end_ms long, text string")
    assert [r.block for r in sinks.subtitles(rows).orderBy("index").collect()] == ["1\n00:00:00,000 --> 00:00:01,500\na\n", "2\n01:01:01,001 --> 01:01:02,000\nb\n"]
    assert sinks.subtitles(rows, kind="vtt").orderBy("index").first().block.startswith("00:00:00.000")


def chunks():
    """250 ms speech twice, 200 and 150 ms silence, then a long quiet stretch, in two sessions."""
    rows, at = [], 0
    for samples, speech in ((4000, True), (4000, True), (3200, False), (2400, False), (16000, False), (16000, False)):
        rows.append((at, samples, speech))
        at += samples
    return [(s, *r) for s in "ab" for r in rows]


KIND = "session string, start_sample long, samples int, speech boolean"


def test_session_scenario(spark):
    got = sessions.batch_events(spark.createDataFrame(chunks(), KIND)).where("session = 'a'").orderBy("sequence").collect()
    assert [r.kind for r in got] == ["speech_start", "partial", "final", "refine", "session_summary"]
    assert (got[2].start_sample, got[2].end_sample, got[2].reason) == (0, 13600, "silence")


def test_longest_beats_silence_and_history_is_bounded():
    m = sessions.Machine(sessions.Limits(longest=8000, history=2, refine=10**9))
    events = [e for i in range(12) for e in m.feed(i * 4000, 4000, True)]
    assert [e[1] for e in events if e[1] == "final"] == ["final"] * 6 and len(m.waiting) == 2
    assert {e[5] for e in events if e[1] == "final"} == {"max-speech"}
    with pytest.raises(ValueError, match="continue"):
        list(m.feed(0, 10, False))


def test_state_survives_a_dump():
    a, b = sessions.Machine(), sessions.Machine()
    for _, start, samples, speech in chunks()[:6]:
        x = list(a.feed(start, samples, speech))
        b = sessions.Machine.load(b.dump(), b.limits)
        assert x == list(b.feed(start, samples, speech))


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = chunks()
    for i in range(6):
        spark.createDataFrame([r for r in rows if r[1] == sorted({x[1] for x in rows})[i]], KIND).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = sessions.stream_events(stream).writeStream.format("memory").queryName("got").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("got").collect()}
    want = {tuple(r) for r in sessions.batch_events(spark.createDataFrame(rows, KIND)).where("kind <> 'session_summary'").collect()}
    assert got == want


def test_checkpointed_sink_resumes(spark, tmp_path, sf):
    source = tmp_path / "src"
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.where("event_id % 2 = 0").write.parquet(str(source))
    for part in (None, e.where("event_id % 2 = 1")):
        if part is not None:
            part.write.mode("append").parquet(str(source))
        q = sessions.checkpointed(spark.readStream.schema(e.schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == e.count() and out.select("event_id").distinct().count() == e.count()


def test_windowed_counts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "w"))
    q = sessions.windowed(stream, "ts", size="1 day", step="1 day", by=("event_type",)).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == e.count()


def test_stream_of_groups_equals_batch(spark, tmp_path):
    from quillspark.operators.intervals import grouped_finals

    kind = "session string, id string, start long, end long"
    spans = [(0, 5), (6, 12), (13, 18), (40, 44), (45, 90), (200, 201)]
    rows = [(s, f"{i}", a, b) for s in "ab" for i, (a, b) in enumerate(spans)]
    source = str(tmp_path / "g")
    for i in range(len(spans)):
        spark.createDataFrame([r for r in rows if r[1] == str(i)], kind).coalesce(1).write.mode("append").parquet(source)
    options = dict(idle=10, longest=30, most=2)
    q = sessions.stream_groups(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), **options).writeStream.format("memory").queryName("groups").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in grouped_finals(spark.createDataFrame(rows, kind), **options).where("trigger <> 'eof'").select("session", "group", "first", "last", "start", "end", "parents", "trigger").collect()}
    assert {tuple(r) for r in spark.table("groups").collect()} == want and {r[7] for r in want} == {"idle-gap", "max-duration", "parent-limit"}
