"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks of words, for sources and then for shards."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import WORD, cut, load

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 16
#: A shard holds 512 documents or more; beyond MAX_SHARDS shards they grow instead of becoming more.
SHARD_DOCS = 512
MAX_SHARDS = 20_000
SEED = 20_240_917
#: Sources whose figures are broadcast, a row of some 50 bytes each; beyond, tasks that a source's rows are dealt over.
BROADCAST_SOURCES, SALTS = 100_000, 64


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Share sum(sizes) by weight; none gets over ``max_repeats`` times its size, the excess is shared again."""
    left, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    out = [0.0] * len(sizes)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1), ties to the earlier.

    The rounding of votes / (votes per seat) is within a seat a party of the answer; from there single seats move.
    """
    total = math.fsum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [math.floor(v * seats / total + 0.5) for v in votes]
    short = seats - sum(got)
    if short > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, got, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif short < 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, got, strict=True)) if s > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def capped(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague, but nobody gets over ``most``; what that leaves is dealt to the others in the same way."""
    out, open_ = [0] * len(votes), list(range(len(votes)))
    while open_ and seats > 0:
        got = sainte_lague([votes[i] for i in open_], seats)
        full = {i for i, g in zip(open_, got, strict=True) if g > most[i]}
        for i, g in zip(open_, got, strict=True):
            out[i] = most[i] if i in full else g
        if not full:
            break
        seats -= sum(most[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs``; with ``carry`` also a struct of those columns, ``carried``.

    size: words of the text (null: 0). Sources in order of code points, null last, weigh ``weights`` in turn.
    Blocks of ``block_words`` words are given to sources by Sainte-Lague on their targets, and each source's blocks
    to its shards by Sainte-Lague on the shards' words. A shard deals its documents in a seeded order end to end,
    and its blocks are the first of that stream, which starts anew when it is used up, ``max_repeats`` times at most.

    Shards are hashes of ids and texts, so a source with a third of all rows is many shards and no task sorts more than a
    shard. Documents without words take part with 0. Null ids are dealt by their texts. Rows that repeat an id are rows of
    their own and tie by size, then by what they carry. Empty tables give no rows; texts are counted whole, however long;
    columns beside those named aren't read, whatever their names. The result depends on the rows alone, not on how they
    are partitioned. The driver gets one row for each source and shard: at most MAX_SHARDS more rows than there are
    sources. Rows meet their source's figures by broadcast up to BROADCAST_SOURCES sources, beyond in a join that deals
    each source over SALTS tasks.
    """
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    row = [F.struct(*carry).alias("carried")] if carry else []
    kept = ["carried"] if carry else []
    mark = F.xxhash64(F.lit(seed), id_col, F.xxhash64(F.col(text_col).cast("string")))
    sized = cut(docs.select(F.col(id_col).alias("id"), src.alias("src"), mark.alias("mark"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row))
    sources = sorted(sized.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect(), key=lambda r: (r.src[0], r.src[1:]))
    words = [int(r.words) for r in sources]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(sources))], max_repeats)
    blocks = sainte_lague(goal, round(math.fsum(goal) / block_words))

    spark = docs.sparkSession
    per_shard = max(SHARD_DOCS, math.ceil(sum(r.n for r in sources) / MAX_SHARDS))
    shards_of = spark.createDataFrame([(r.src, max(1, math.ceil(r.n / per_shard)), w, g) for r, w, g in zip(sources, words, goal, strict=True)], "src string, shards int, source_size long, target double")
    if len(sources) <= BROADCAST_SOURCES:
        met = sized.join(F.broadcast(shards_of), "src")
    else:
        met = sized.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int")).join(shards_of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["src", "salt"]).drop("salt")
    placed = met.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "mark"), F.col("shards")).cast("int"))
    shards: dict[str, list] = {}
    for r in placed.groupBy("src", "shard").agg(F.sum("size").alias("words")).collect():
        shards.setdefault(r.src, []).append((r.shard, int(r.words)))
    quota = []
    for r, b in zip(sources, blocks, strict=True):
        own = sorted(shards[r.src])
        for (shard, n), q in zip(own, capped([float(n) for _, n in own], b, [-(-max_repeats * n // block_words) for _, n in own]), strict=True):
            quota.append((r.src, shard, n, min(q * block_words, max_repeats * n)))
    quotas = spark.createDataFrame(quota, "src string, shard int, shard_words long, quota long")

    w = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size", *kept).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(w), F.lit(0))
    passes = F.when(F.col("shard_words") > 0, F.expr("quota div shard_words")).otherwise(F.lit(0))
    rest = F.when(F.col("shard_words") > 0, F.col("quota") % F.col("shard_words")).otherwise(F.lit(0))
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.join(quotas, ["src", "shard"]).withColumn("before", before).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), *kept)


def op2_query(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents"))
