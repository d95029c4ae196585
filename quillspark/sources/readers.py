"""Typed readers. Names may be in camel or snake case; what a contract forbids raises when a row with it is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CANDIDATE = """candidateId string, text string, tokenIds array<bigint>, acoustic double, mora double, lexical double, preservation double, crossModel double, teacher double, reading string, rank int,
  hypothesisCount int, sequenceScore double, avgLogprob double, beamConfidence double, source string, metadata map<string,string>"""
BENCHMARK = f"sampleId string, groupId string, sourceId string, split string, reference string, annotatedReference string, domain string, nearDuplicateId string, candidates array<struct<{re.sub(r'(\w+) (\w+(?:<[^>]*>)?)', r'\1:\2', CANDIDATE)}>>"
AUDIO = "sampleId string, groupId string, sourceId string, split string, audioPath string, reference string, domain string, nearDuplicateId string, rightsDecision string, licenseId string, datasetName string, datasetRevision string"
RISK = "sampleId string, groupId string, k int, loss double, costMs double, split string"
CALIBRATION = "sampleId string, groupId string, score double, correct boolean, split string"
SPLITS = ("train", "dev", "calibration", "test", "regression-exposed")


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def must(value: Column, condition: Column, message: str) -> Column:
    """The value, where the condition holds; elsewhere reading it raises."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in camel or snake case to snake-case columns; blank lines are passed over, broken ones raise."""
    wanted = StructType.fromDDL(schema)
    both = StructType([*wanted.fields, *[StructField(snake(f.name), f.dataType) for f in wanted.fields if snake(f.name) != f.name]])
    rows = spark.read.schema(both).option("mode", "FAILFAST").json(path)
    return rows.select(*[F.coalesce(f.name, snake(f.name)).alias(snake(f.name)) if snake(f.name) != f.name else F.col(f.name) for f in wanted.fields])


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    rows = read_lines(spark, path, BENCHMARK)
    rows = rows.withColumn("split", must(F.col("split"), F.col("split").isin(*SPLITS), "unknown split"))
    return rows.withColumn("sample_id", must(F.col("sample_id"), F.length("sample_id") > 0, "a sample without an id"))


def candidate_rows(benchmark: DataFrame) -> DataFrame:
    """A row for each candidate of each sample, in snake case, with group_id = sample_id."""
    c = benchmark.select(F.col("sample_id").alias("group_id"), F.posexplode("candidates").alias("place", "c"))
    fields = benchmark.schema["candidates"].dataType.elementType.fieldNames()
    out = c.select("group_id", "place", *[F.col(f"c.{f}").alias(snake(f)) for f in fields])
    fine = F.length("candidate_id") > 0
    finite = lambda x: F.col(x).isNull() | (~F.isnan(x) & (F.abs(x) < float("inf")))
    for f in ("acoustic", "mora", "lexical", "preservation", "cross_model", "teacher", "avg_logprob", "sequence_score", "beam_confidence"):
        out = out.withColumn(f, must(F.col(f), finite(f), f"{f} isn't finite"))
    return out.withColumn("candidate_id", must(F.col("candidate_id"), fine, "a candidate without an id"))


def read_audio_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = read_lines(spark, path, AUDIO)
    pair = F.col("dataset_name").isNull() == F.col("dataset_revision").isNull()
    rows = rows.withColumn("rights_decision", must(F.col("rights_decision"), F.col("rights_decision").isin("allow", "deny", "review"), "unknown rights decision"))
    return rows.withColumn("sample_id", must(F.col("sample_id"), pair, "dataset name and revision come together"))


def read_split(spark: SparkSession, path: str, schema: str, split: str) -> DataFrame:
    """Rows of one split; a row of any other raises."""
    rows = read_lines(spark, path, schema)
    return rows.withColumn("split", must(F.col("split"), F.col("split").eqNullSafe(F.lit(split)), f"only {split} rows are admitted"))


def read_risk(spark: SparkSession, path: str) -> DataFrame:
    rows = read_split(spark, path, RISK, "calibration")
    return rows.withColumn("loss", must(F.col("loss"), F.col("loss").between(0, 1), "losses are in [0, 1]"))


def read_second_ear(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, texts, seconds, model_revision), the last line of each sample; lines that aren't objects are passed over.

    More than one model revision raises.
    """
    kind = "sampleId string, sample_id string, hypotheses array<string>, seconds double, modelRevision string, model_revision string"
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.btrim("value").alias("v")).where(F.col("v").startswith("{"))
    rows = text.select("n", F.from_json("v", kind, {"mode": "FAILFAST"}).alias("r")).select("n", F.coalesce("r.sampleId", "r.sample_id").alias("sample_id"), F.col("r.hypotheses").alias("texts"), "r.seconds", F.coalesce("r.modelRevision", "r.model_revision").alias("model_revision"))
    one = rows.agg(F.count_distinct("model_revision").alias("n")).first().n
    if one > 1:
        raise ValueError(f"{one} model revisions in one second-ear file")
    return rows.groupBy("sample_id").agg(*[F.max_by(c, "n").alias(c) for c in ("texts", "seconds", "model_revision")])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, revision, entry_id, phrase, aliases, reading, tags, priority) of a catalogue file."""
    kind = "name string, revision string, entries array<struct<id:string,phrase:string,aliases:array<string>,reading:string,tags:array<string>,priority:double>>"
    rows = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path).select("name", "revision", F.explode("entries").alias("e"))
    empty = F.array().cast("array<string>")
    return rows.select("name", "revision", F.col("e.id").alias("entry_id"), must(F.col("e.phrase"), F.length("e.phrase").between(1, 160), "phrases have 1 to 160 characters").alias("phrase"), F.coalesce("e.aliases", empty).alias("aliases"), "e.reading", F.coalesce("e.tags", empty).alias("tags"), F.coalesce("e.priority", F.lit(0.0)).alias("priority"))


def read_rights(spark: SparkSession, path: str, operations: tuple[str, ...]) -> DataFrame:
    """(asset_id, operations...) of a registry file {"records": [...]}; states other than allow, deny, review raise."""
    camel = lambda s: re.sub(r"_(\w)", lambda m: m[1].upper(), s)
    fields = ",".join(f"{camel(o)}:string" for o in operations)
    rows = spark.read.schema(f"records array<struct<assetId:string,{fields}>>").option("multiLine", True).json(path).select(F.explode("records").alias("r"))
    state = lambda o: F.coalesce(F.col(f"r.{camel(o)}"), F.lit("deny"))
    return rows.select(F.col("r.assetId").alias("asset_id"), *[must(state(o), state(o).isin("allow", "deny", "review"), f"unknown state of {o}").alias(o) for o in operations])
