"""From raw documents to token ids: quality, common lines, near copies, mixing of sources, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of ``documents``, whatever others come along. A row without a doc_id can't be followed through the stages and
leaves at the first; null texts count as empty and are empty from the second stage on. Rows that repeat an id are rows
of their own until near copies go; empty tables give no rows; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import cut, load
from quillspark.llm.byte_bpe import encode
from quillspark.llm.line_dedup import drop_common_lines
from quillspark.llm.mixing import mix
from quillspark.llm.near_dedup import near_duplicates
from quillspark.llm.quality_classifier import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, accepts."""
    kept = score_documents(docs.select("doc_id", "text"), load(spark, sf_dir, "labels")).where("predicted = 1")
    return docs.select(COLUMNS).join(kept.select(F.col("doc_id").alias("kept_id")).distinct(), F.col("doc_id") == F.col("kept_id"), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars is counted again."""
    cleaned = drop_common_lines(docs, carry=("lang", "source")).where("id is not null")
    return cleaned.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least id.

    Rows are told apart by a 64-bit hash of id and text: repeated rows are one, an id with two texts is two documents.
    """
    rows = docs.where("doc_id is not null").select(*COLUMNS, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"))
    classes = near_duplicates(rows.select("row_key", "text"), id_col="row_key").select(F.col("doc_id").alias("class_key"), "class_id").distinct()
    least = rows.select("doc_id", "row_key").join(classes, F.col("row_key") == F.col("class_key")).groupBy("class_id").agg(F.min(F.struct("doc_id", "row_key")).alias("least"))
    kept = rows.join(least.select(F.col("least.row_key").alias("first_key")), F.col("row_key") == F.col("first_key"), "left_semi")
    return kept.groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: the words taken, in whole copies of the row, rounded."""
    taken = mix(docs.where("doc_id is not null"), carry=tuple(COLUMNS)).where("size > 0").select("carried", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("carried.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document, with digests of them and of what they decode to."""
    import public_tokenizers

    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("source",))
    return coded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("source_mixing", mixed), ("byte_level_bpe", tokens)]

#: Learnt scores, hashes and token ids can't be stated in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again as the next one's documents."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
