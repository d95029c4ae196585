"""Splits, leaks between them, parents, rights: audits over lineage records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Lineage columns and the kind of leak that a value in two splits is.
DIMENSIONS = {
    "audio_sha256": "audio-sha256", "pcm_sha256": "pcm-sha256", "speaker_id": "speaker-id", "session_id": "session-id", "source_recording_id": "source-recording-id",
    "reference_lineage_id": "reference-lineage-id", "derivation_group_id": "derivation-group-id", "near_duplicate_id": "near-duplicate-id", "reference_digest": "reference-digest",
}
OPERATIONS = ("download", "local_inference", "evaluation", "training", "derivative_weights", "redistribution", "publication", "commercial_use", "voice_cloning")


def assign_split(identifier: Column, seed: str) -> Column:
    """train (< 0.6), calibration (< 0.8) or test, by the first byte of sha256(seed:id) over 255."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), identifier.cast("string")), 256), 1, 2), 16, 10).cast("int") / 255
    return F.when(share < 0.6, "train").when(share < 0.8, "calibration").otherwise("test")


def leakage(records: DataFrame, dimensions: dict[str, str] = DIMENSIONS, *, parents: bool = True) -> DataFrame:
    """(kind, value, splits, sample_ids): values held in more than one split, and children apart from their parents.

    All dimensions are unpivoted into one grouping, so there is one exchange however many there are. Split sets are
    aggregated first, with partial results; sample ids are gathered only for the values that leak.
    """
    on = [c for c in dimensions if c in records.columns]
    pairs = records.select("sample_id", "split", F.explode(F.array(*[F.struct(F.lit(dimensions[c]).alias("kind"), F.col(c).cast("string").alias("value")) for c in on])).alias("x"))
    pairs = pairs.select("sample_id", "split", "x.kind", "x.value").where(F.col("value").isNotNull() & (F.col("value") != ""))
    leaking = pairs.groupBy("kind", "value").agg(F.collect_set("split").alias("splits")).where(F.size("splits") > 1)
    found = pairs.join(leaking, ["kind", "value"]).groupBy("kind", "value", F.array_sort("splits").alias("splits")).agg(F.array_sort(F.collect_set("sample_id")).alias("sample_ids"))
    if not parents:
        return found
    child = records.select("sample_id", "split", F.explode("parent_sample_ids").alias("parent_id"))
    parent = records.select(F.col("sample_id").alias("parent_id"), F.col("split").alias("parent_split"))
    crossed = child.join(parent, "parent_id").where("split <> parent_split").select(F.lit("parent-sample-id").alias("kind"), F.col("parent_id").cast("string").alias("value"), F.array_sort(F.array("split", "parent_split")).alias("splits"), F.array_sort(F.array("sample_id", "parent_id")).alias("sample_ids"))
    return found.unionByName(crossed.distinct())


def missing_parents(records: DataFrame) -> DataFrame:
    edges = records.select("sample_id", F.explode("parent_sample_ids").alias("parent_id"))
    return edges.join(records.select(F.col("sample_id").alias("parent_id")), "parent_id", "left_anti").select("sample_id", "parent_id")


def _on_cycles(edges: pa.Table) -> pa.Array:
    """Nodes of (a, b) on a cycle: those of strong components with several nodes, and those with an edge to themselves."""
    both = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks], edges.schema.field("a").type).combine_chunks().dictionary_encode()
    a, b = np.split(both.indices.to_numpy(), 2)
    n, order = len(both.dictionary), np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    cyclic = np.zeros(n, dtype=bool)
    cyclic[a[a == b]] = True
    # Tarjan's components with a stack of its own; a settled node's low mark is n.
    seen, low, stack, clock = [-1] * n, [n] * n, [], 0
    at = first[:-1]
    for root in range(n):
        if seen[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v] = low[v] = clock
                clock += 1
                stack.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if seen[w] < 0:
                    path.append(w)
                else:
                    low[v] = min(low[v], low[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                size = len(stack)
                while True:
                    w = stack.pop()
                    low[w] = n
                    if w == v:
                        break
                    cyclic[w] = True
                if size - len(stack) > 1:
                    cyclic[v] = True
    return both.dictionary.filter(pa.array(cyclic))


def cyclic_samples(records: DataFrame, *, max_rounds: int | None = None, task_edges: int = 1_000_000) -> DataFrame:
    """Samples on a cycle of the parent graph: those that reach themselves.

    A graph of up to ``task_edges`` edges is settled in one task, in time linear in its edges. Of a larger one everything without
    a parent or without a child is peeled off, round by round, until so few edges are left; where that stops earlier, what is
    left lies on cycles or on paths between them, and its reachability is squared until it stops growing. A graph that
    10,000 rounds don't settle raises. With ``max_rounds`` every graph is settled in rounds, at most so many.
    """
    from quillspark.sources.sinks import settle

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if sum(len(b) for b in own):
            yield pa.RecordBatch.from_arrays([_on_cycles(pa.Table.from_batches(own))], ["sample_id"])

    in_task = lambda e: e.repartition(1).mapInArrow(small, StructType([StructField("sample_id", e.schema["a"].dataType)]))
    edges = settle(records.select(F.col("sample_id").alias("a"), F.explode("parent_sample_ids").alias("b")).join(records.select(F.col("sample_id").alias("b")), "b", "left_semi").select("a", "b").distinct())
    n, rounds = edges.count(), max_rounds or 10_000
    for _ in range(rounds):
        if max_rounds is None and n <= task_edges:
            return in_task(edges)
        heads, tails = edges.select("b").distinct(), edges.select("a").distinct()
        edges = settle(edges.join(heads.withColumnRenamed("b", "a"), "a", "left_semi").join(tails.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
        left = edges.count()
        if left == n or not left:
            break
        n = left
    else:
        raise RuntimeError(f"parents not peeled off after {rounds} rounds")
    reach, m = edges, n
    for _ in range(rounds):
        if not m:
            break
        longer = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a"), F.col("y.b"))
        reach = settle(reach.union(longer).distinct())
        grown = reach.count()
        if grown == m:
            break
        m = grown
    else:
        raise RuntimeError(f"reachability still grows after {rounds} rounds")
    return reach.where("a = b").select(F.col("a").alias("sample_id")).distinct()


def integrity(records: DataFrame) -> DataFrame:
    """One row: records, records by split, and how many lack what an audit needs."""
    unknown = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return records.agg(
        F.count("*").alias("records"), *[F.count_if(F.col("split") == s).alias(f"{s}_records") for s in ("train", "calibration", "test")],
        unknown("speaker_id").alias("unknown_speaker"), unknown("pcm_sha256").alias("missing_pcm"), unknown("rights_asset_id").alias("unknown_rights"), F.count_distinct("sample_id").alias("samples"),
    )


def denied(records: DataFrame, registry: DataFrame, operation: str) -> DataFrame:
    """Records whose asset isn't known to allow the operation: unknown assets, and any state but ``allow``."""
    states = registry.select(F.col("asset_id").alias("rights_asset_id"), F.col(operation).alias("state"))
    return records.join(states, "rights_asset_id", "left").withColumn("state", F.coalesce("state", F.lit("unknown"))).where("state <> 'allow'")


def require(violations: DataFrame, message: str) -> None:
    """Raise if there is any row."""
    first = violations.take(1)
    if first:
        raise PermissionError(f"{message}: {first[0].asDict()}")


def visible(records: DataFrame, purpose: str) -> DataFrame:
    """What a purpose may see: training the train split, calibration its own, evaluation the test split."""
    return records.where(F.col("split").isin({"training": ["train"], "calibration": ["calibration"], "evaluation": ["test"]}[purpose]))


def redacted(records: DataFrame, secret_columns: list[str], dropped: list[str]) -> DataFrame:
    """Identifiers as digests, texts left out."""
    return records.drop(*dropped).withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in secret_columns})
