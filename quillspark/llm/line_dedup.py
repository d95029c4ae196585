"""Line dedup in DataFrame functions only: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import BLANKS, cut, meet

MIN_CHARS = 40
MIN_DOCS = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _UPPER.lower())


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text), a row for each row of ``docs``; with ``carry`` also a struct of those columns, ``carried``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines
    everywhere but in the largest id that holds it; there all of them stay.

    Null or empty text: one empty line. Rows that repeat an id count as one document for the
    threshold and are cleaned each by its own text. A null id
    never counts as a document, so its lines go whenever enough others hold them. Empty tables give no rows.
    Texts are taken whole, however long; columns beside the two named aren't read, whatever their names.
    Only 16-byte line fingerprints (two 64-bit hashes) are shuffled to be counted; the count first collapses each
    (line, document) and then each line, both with map-side partial sums, so a line that a third of all documents
    hold is spread over tasks. Its lines then meet their count where they are, since the few keys that hold many lines
    are broadcast; the lines of all other keys meet theirs in a shuffle. Texts move once, to
    meet the positions that they lose.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *([F.struct(*carry).alias("carried")] if carry else []))
    rows = rows.withColumn("print", F.xxhash64("body"))
    lines = cut(
        rows.select("id", "print", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("id", "print", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "print", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    )
    common = cut(lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"), F.count("*").alias("held")).where(F.col("n") >= min_docs).drop("n"))
    lost = meet(lines, common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias("lost_id"), F.col("print").alias("lost_print")).agg(F.collect_set("pos").alias("lost"))
    split = F.split("body", "\n", -1)
    both = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("print") == F.col("lost_print")), "left")
    kept = F.when(F.col("lost").isNull(), F.col("body")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.array_contains("lost", i)), "\n"))
    # Every \n counts one line more; counting them needs no second split.
    n_lines = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1
    return both.select("id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"), *(["carried"] if carry else []))


def op7_query(spark, sf_dir):
    from quillspark.llm._common import load

    out = drop_common_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS lost FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN lost THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
