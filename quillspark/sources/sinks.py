"""Writers, and tables that settle an intermediate result."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import canonical as J


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage at a checkpoint in the shared folder, spark.checkpoint.dir; a session in one JVM may go without it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillspark-checkpoints-"))
    return df.checkpoint()


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One JSON object a line; an existing target is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def partition_by_split(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").json(path)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table with each key's newest row, of equal versions that of ``changes``."""
    from pyspark.sql import Window

    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))).where("_r = 1").drop("_r", "_new")


def clock(ms: Column, mark: str) -> Column:
    """hh:mm:ss,mmm of milliseconds, with ``mark`` before the last part."""
    part = lambda d, m: (F.floor(ms / d) % m).cast("int")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1_000, 60), (ms % 1_000).cast("int"))


def subtitles(rows: DataFrame, *, kind: str = "srt") -> DataFrame:
    """(recording, index, block) of (recording, index, start_ms, end_ms, text): one numbered block for each row."""
    mark = {"srt": ",", "vtt": "."}[kind]
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("recording").orderBy("index"))
    head = F.concat(number.cast("string"), F.lit("\n")) if kind == "srt" else F.lit("")
    return rows.select("recording", "index", F.concat(head, clock(F.col("start_ms"), mark), F.lit(" --> "), clock(F.col("end_ms"), mark), F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"))


def cache_key(fields: dict[str, Column]) -> Column:
    """Digest of all fields' texts under their names; null and the text "null" differ."""
    return J.digest(J.record({k: J.quoted(c.cast("string")) for k, c in fields.items()}))


def documents(recordings: DataFrame, segments: DataFrame, formats: tuple[str, ...] = ("srt", "vtt", "md", "observed.txt", "normalized.txt")) -> DataFrame:
    """(recording, format, document): each recording's segments as subtitles, as an audit report and as plain texts.

    ``recordings``: (recording, name, audio_sha256, evidence_sha256, duration_ms, provisional, observed, normalized); ``segments``:
    (recording, index, start_ms, end_ms, text, decision, warnings). A recording without segments has empty lists of them.
    """
    stamp = clock(F.col("start_ms"), ".")
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit(" \u26a0\ufe0f `"), F.array_join("warnings", ", "), F.lit("`"))).otherwise(F.lit(""))
    rows = segments.withColumn("line", F.concat(F.lit("- `"), stamp, F.lit("` ["), F.col("decision"), F.lit("] "), F.col("text"), warned))
    cue = lambda mark: F.concat(clock(F.col("start_ms"), mark), F.lit(" --> "), clock(F.col("end_ms"), mark), F.lit("\n"), F.col("text"), F.lit("\n"))
    per = rows.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("index", "line", cue(",").alias("srt"), cue(".").alias("vtt")))).alias("all"))
    part = lambda name: F.coalesce(F.transform("all", lambda x: x[name]), F.array().cast("array<string>"))
    head = F.format_string("# %s\n\n- Audio SHA-256: `%s`\n- Evidence SHA-256: `%s`\n- Duration: `%.3f` seconds\n- Provisional windows: `%d`", "name", "audio_sha256", "evidence_sha256", F.col("duration_ms") / 1000, "provisional")
    report = F.concat(F.rtrim(F.concat(head, F.lit("\n\n## Observed transcript\n\n"), F.col("observed"), F.lit("\n\n## Normalized transcript\n\n"), F.col("normalized"), F.lit("\n\n## Timeline\n\n"), F.array_join(part("line"), "\n")), F.lit(" \n")), F.lit("\n"))
    made = {
        "srt": F.array_join(F.transform(part("srt"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x)), "\n"), "vtt": F.concat(F.lit("WEBVTT\n\n"), F.array_join(part("vtt"), "\n")),
        "md": report, "observed.txt": F.concat("observed", F.lit("\n")), "normalized.txt": F.concat("normalized", F.lit("\n")),
    }
    both = recordings.join(per, "recording", "left")
    return both.select("recording", F.explode(F.array(*[F.struct(F.lit(f).alias("format"), made[f].alias("document")) for f in formats])).alias("d")).select("recording", "d.*")


def write_documents(made: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One folder a format and a recording, each with a text file; an existing target is an error unless ``overwrite``."""
    made.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("format", "recording").option("lineSep", "\n").text(path)
