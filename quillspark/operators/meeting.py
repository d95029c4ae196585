"""Meetings: channel spans, transcript events with an authority, and what makes their evidence inconsistent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import canonical as J

LIVE, OBSERVED, NORMALISED = "live-provisional", "final-observed", "normalized-derivative"
# By authority, the id's prefix and the names that the hashed record gives to the evidence and to who wrote the text.
IDENTITY = {LIVE: ("live-", None, "backend"), OBSERVED: ("observed-", "evidenceDigest", "backend"), NORMALISED: ("normalized-", "observedEvidenceDigest", "normalizer")}


def channel_spans(rows: DataFrame) -> DataFrame:
    """Adds ``end_ms`` to (span_id, start_ms, sample_rate, sample_count, ...): the duration is rounded half to even.

    A rate or count below one gives a null end, which ``span_problem`` reports.
    """
    length = F.rint(F.col("sample_count") / F.col("sample_rate") * 1000).cast("long")
    return rows.withColumn("end_ms", F.when((F.col("sample_rate") >= 1) & (F.col("sample_count") >= 1), F.col("start_ms") + length))


def span_problem() -> Column:
    """What is wrong with a span of (span_id, start_ms, end_ms, audio_sha256, recording_sha256, aec_applied, aec_digest), or null."""
    bad = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    return (
        F.when(F.coalesce("span_id", F.lit("")) == "", F.lit("span-without-id"))
        .when(~F.coalesce((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")), F.lit(False)), F.lit("invalid-interval"))
        .when(bad("audio_sha256"), F.lit("audio-digest")).when(bad("recording_sha256"), F.lit("recording-digest"))
        .when(F.col("aec_applied") & (F.coalesce("aec_digest", F.lit("")) == ""), F.lit("echo-cancelling-without-provenance"))
    )


def events(rows: DataFrame, authority: str) -> DataFrame:
    """(event_id, authority, ...) of (span_id, text, writer, revision, evidence): the id is a digest of what the event says.

    Live text has no evidence; observed text has its own digest, a normalised one the digest of the observed text it comes from.
    """
    prefix, evidence, writer = IDENTITY[authority]
    said = {"spanId": J.quoted(F.col("span_id")), "text": J.quoted(F.col("text")), writer: J.quoted(F.col("writer")), "revision": J.quoted(F.col("revision")), "authority": J.quoted(F.lit(authority))}
    if evidence:
        said[evidence] = J.quoted(F.col("evidence"))
    return rows.withColumns({"event_id": F.concat(F.lit(prefix), F.substring(J.digest(J.record(said, spaced=True)), 1, 16)), "authority": F.lit(authority)})


def authoritative(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("authority") == OBSERVED)


def normalised(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("authority") == NORMALISED)


def problems(spans: DataFrame, told: DataFrame) -> DataFrame:
    """(meeting_id, id, problem) of everything inconsistent; no row means that the evidence holds.

    ``spans``: (meeting_id, span_id, ...) as ``span_problem`` takes them; ``told``: (meeting_id, event_id, span_id, text,
    authority, evidence). Ids are unique within a meeting, events name a span of it, observed events have a digest and
    normalised ones that of an observed event of the meeting. Two groupings and two equi-joins, whatever a meeting's size.
    """
    none = F.coalesce("evidence", F.lit("")) == ""
    alone = (
        F.when((F.coalesce("event_id", F.lit("")) == "") | (F.coalesce("span_id", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == ""), F.lit("event-incomplete"))
        .when((F.col("authority") == LIVE) & ~none, F.lit("live-claims-evidence")).when((F.col("authority") == OBSERVED) & none, F.lit("observed-without-evidence"))
    )
    known = spans.select("meeting_id", "span_id").distinct()
    seen = authoritative(told).where(~none).select("meeting_id", "evidence").distinct()
    twice = lambda df, c, why: df.groupBy("meeting_id", F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("meeting_id", "id", F.lit(why).alias("problem"))
    found = [
        spans.select("meeting_id", F.col("span_id").alias("id"), span_problem().alias("problem")).where("problem is not null"),
        told.select("meeting_id", F.col("event_id").alias("id"), alone.alias("problem")).where("problem is not null"),
        twice(spans, "span_id", "span-repeated"), twice(told, "event_id", "event-repeated"),
        told.join(known, ["meeting_id", "span_id"], "left_anti").select("meeting_id", F.col("event_id").alias("id"), F.lit("unknown-span").alias("problem")),
        normalised(told).join(seen, ["meeting_id", "evidence"], "left_anti").select("meeting_id", F.col("event_id").alias("id"), F.lit("unknown-evidence").alias("problem")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
