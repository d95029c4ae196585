"""Choosing catalogue entries for a query by similarity of surface and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import canonical as J
from quillspark.functions.text import phrase_similarity
from quillspark.sources.sinks import settle

#: A catalogue of at most this many distinct surfaces is broadcast; a larger one is dealt into blocks of about so many.
MAX_ENTRIES = 100_000
#: Query texts that meet a block of a dealt catalogue in one task, about.
TILE_QUERIES = 1_000


def select(queries: DataFrame, entries: DataFrame, *, limit: int = 10, minimum: float = 0.5, tags: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, entry_id, phrase, score, surface, position): each query's best entries at or above ``minimum``.

    ``queries``: (query_id, query, reading); ``entries``: (entry_id, phrase, aliases, reading, tags, priority), all texts
    folded already. An entry must have every tag asked for. Order: score, priority, entry_id. Each distinct pair of
    texts is scored once, whatever number of queries and entries has them; of up to MAX_ENTRIES distinct surfaces
    all are broadcast; of more, every block of them meets every part of the queries.
    """
    if tags:
        entries = entries.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    surfaces = entries.select("entry_id", "phrase", "priority", F.explode(F.concat(F.array(F.struct(F.lit(False).alias("phonetic"), F.col("phrase").alias("surface"))), F.transform("aliases", lambda a: F.struct(F.lit(False).alias("phonetic"), a.alias("surface"))), F.array(F.struct(F.lit(True).alias("phonetic"), F.coalesce("reading", F.lit("")).alias("surface"))))).alias("s")).select("entry_id", "phrase", "priority", "s.*").where("surface <> ''").distinct()
    # Of the entries of one surface only the first ``limit`` can be among a query's best: each of these goes before the others
    # by the same score or a better one. So do those of one query text, for the queries that ask it.
    first = F.row_number().over(Window.partitionBy("phonetic", "surface").orderBy(F.desc("priority"), "entry_id", "phrase"))
    leading = settle(surfaces.withColumn("_r", first).where(F.col("_r") <= limit).drop("_r"))
    held = leading.groupBy("phonetic", "surface").agg(F.collect_list(F.struct("entry_id", "phrase", "priority")).alias("entries"))
    n = leading.select("phonetic", "surface").distinct().count()
    queries = queries.where(F.length("query") > 0).select("query_id", "query", F.coalesce("reading", F.lit("")).alias("reading"))
    asked = queries.select("query", "reading").distinct()
    plain, spoken = phrase_similarity(F.col("query"), F.col("surface")), phrase_similarity(F.col("reading"), F.col("surface"), phonetic=True)
    if n <= MAX_ENTRIES:
        met = asked.join(F.broadcast(held))
    else:
        blocks, parts = -(-n // MAX_ENTRIES), max(1, -(-asked.count() // TILE_QUERIES))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        dealt = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k)).cast("int")
        left = asked.withColumn("part", dealt(parts, "query", "reading")).withColumn("block", every(blocks))
        right = held.withColumn("block", dealt(blocks, "phonetic", "surface")).withColumn("part", every(parts))
        met = left.join(right, ["block", "part"]).drop("block", "part")
    scored = met.withColumn("score", F.when(F.col("phonetic"), spoken).otherwise(plain)).where(F.col("score") >= minimum)
    scored = scored.select("query", "reading", "score", "phonetic", "surface", F.explode("entries").alias("e")).select("query", "reading", "score", "phonetic", "surface", "e.*")

    def best(rows: DataFrame, by: list[str], b: Column) -> DataFrame:
        """The ``limit`` best entries of each query, by the best that each entry has."""
        each = rows.groupBy(*by, "entry_id", "phrase", "priority").agg(F.max(b).alias("b"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("b.score"), F.desc("priority"), "entry_id", "phrase"))
        return each.withColumn("position", rank).where(F.col("position") <= limit)

    texts = best(scored, ["query", "reading"], F.struct("score", (~F.col("phonetic")).alias("p"), "surface"))
    found = best(queries.join(texts.drop("position"), ["query", "reading"]), ["query_id"], F.col("b"))
    return found.select("query_id", "entry_id", "phrase", F.col("b.score").alias("score"), F.col("b.surface").alias("surface"), "position")


def prompt_context(rows: DataFrame, sections: dict[str, Column], *, most: int = 12_000, revision: str = "document-context-v2") -> DataFrame:
    """Adds ``prompt``: the context of a document as canonical JSON of at most ``most`` characters.

    ``sections``: JSON of each, in order; null leaves a section out. What is longer becomes its longest beginning that fits
    together with the digest of the whole, or, where not even that digest fits, the beginning of the record that holds it.
    """
    if most < 0:
        raise ValueError("the limit isn't negative")
    label = J.quoted(F.lit(revision))
    kept = F.array_compact(F.array(*[F.when(v.isNotNull(), J.array(F.array(J.quoted(F.lit(k)), v))) for k, v in sections.items()]))
    whole = rows.withColumn("_whole", J.record({"format": label, "sections": J.array(kept)}))
    seal = F.when(F.length("_whole") > most, J.digest(J.record({"fullContext": J.quoted(F.col("_whole"))})))
    sealed = whole.withColumn("_seal", seal)
    ends = {"format": label, "fullContextSha256": J.quoted(F.col("_seal")), "truncated": F.lit("true")}
    sealed = sealed.withColumn("_bare", J.record(ends)).withColumn("_room", F.lit(most) - F.length(J.record({**ends, "contextPrefix": F.lit('""')})))

    def grow(a: Column, c: Column) -> Column:
        used = a["used"] + J.width(c)
        return F.struct(used.alias("used"), (a["n"] + (used <= F.col("_room")).cast("int")).alias("n"))

    fits = F.aggregate(F.split(F.substring("_whole", 1, most), ""), F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), grow)["n"]
    sealed = sealed.withColumn("_fits", F.when(F.col("_seal").isNotNull() & (F.col("_room") >= 0), fits))
    short = J.record({**ends, "contextPrefix": J.quoted(F.substring(F.col("_whole"), F.lit(1), F.col("_fits")))})
    made = F.when(F.col("_seal").isNull(), F.col("_whole")).when(F.length("_bare") >= most, F.substring("_bare", 1, most)).when(F.col("_room") < 0, F.col("_bare")).otherwise(short)
    return sealed.withColumn("prompt", made if most else F.lit("")).drop("_whole", "_seal", "_bare", "_room", "_fits")
