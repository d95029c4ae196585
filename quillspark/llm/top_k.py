"""Exact top-k inner products by a three-phase uniform threshold over slices of the components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import cut, load

K = 5
SCALE = 256
EVERY = 50
#: Component slices, each with a score list of its own.
SLICES = 4
#: Vectors of a chunk of candidates and of a block of queries.
CHUNK, BLOCK = 2_048, 1_024


def quantised(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) with floor(scale * x), x as double; rows without a whole finite vector are left out."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return table.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _packed(frame: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group: ids and vectors as two blobs of 64-bit integers."""
    spec = ", ".join(f"{c} long" for c in group) + ", ids binary, vs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vs = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in at], pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(vs)], pa.binary())], [*group, "ids", "vs"])

        for b in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[: len(group)]], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            own = b.column(len(group)).to_numpy(zero_copy_only=False)
            flat, size = b.column(len(group) + 1), np.asarray(b.column(len(group) + 1).value_lengths())
            values, first = np.asarray(flat.flatten()), np.concatenate([[0], np.cumsum(size)])
            for a, z in zip(edge, [*edge[1:], len(keys)], strict=True) if len(keys) else ():
                key = tuple(int(x) for x in keys[a])
                if key != at and ids:
                    yield done()
                    ids, vs = [], []
                at = key
                ids.append(own[a:z].astype("<i8").tobytes())
                vs.append(values[first[a] : first[z]].astype("<i8").tobytes())
        if ids:
            yield done()

    return frame.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, spec)


def _matrix(ids: pa.Scalar, vs: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids.as_buffer(), dtype="<i8")
    return i, np.frombuffer(vs.as_buffer(), dtype="<i8").reshape(len(i), -1)


def _bound(q: np.ndarray, c: np.ndarray) -> float:
    """No score's absolute value, nor that of a part of it, is higher."""
    return float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * q.shape[1] if q.size and c.size else 0.0


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products: in doubles where they can't round, else in 64-bit integers (modulo 2**64)."""
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if bound < 2**53 else q @ c.T


def _slices(d: int, m: int) -> list[slice]:
    edge = np.linspace(0, d, min(m, max(1, d)) + 1).astype(int)
    return [slice(a, z) for a, z in zip(edge[:-1], edge[1:], strict=True)]


def _reach(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """For slices of a query's and a candidate's components: no product of the two is higher (Cauchy-Schwarz, rounded up by
    more than sums up to ``bound`` lose as doubles)."""
    return np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None] * np.sqrt((c.astype(float) ** 2).sum(axis=1))[None, :] * (1 + 1e-9) + bound * 1e-12 + 1


def sufficient(q: np.ndarray, c: np.ndarray, t: np.ndarray, slices: list[slice], bound: float, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of every pair whose score reaches its query's cutoff, and maybe some that don't.

    Slice after slice is multiplied; after each, a pair stays only while its known parts and the most that its missing
    ones can add reach the cutoff, and the next slice is multiplied only for candidates that a query still wants. Once few
    pairs are left, each has its missing slices resolved by itself. ``work`` collects how many components were multiplied.
    """
    columns, known = np.arange(len(c)), np.zeros((len(q), len(c)), dtype=np.int64)
    alive = np.ones(known.shape, dtype=bool)
    for n, s in enumerate(slices):
        known = known + _products(q[:, s], c[columns][:, s], bound)
        if work is not None:
            work.append(len(q) * len(columns) * (s.stop - s.start))
        rest = slice(s.stop, q.shape[1])
        alive &= known + _reach(q[:, rest], c[columns][:, rest], bound) >= t[:, None] if n + 1 < len(slices) else known >= t[:, None]
        left = int(alive.sum())
        wanted = alive.any(axis=0)
        columns, known, alive = columns[wanted], known[:, wanted], alive[:, wanted]
        if n + 1 < len(slices) and left * 16 < len(q) * len(columns):
            i, j = np.nonzero(alive)
            score = known[i, j]
            for lo in range(0, len(i), 1 << 16):
                on = slice(lo, lo + (1 << 16))
                score[on] += (q[i[on]][:, rest] * c[columns[j[on]]][:, rest]).sum(axis=1)
            if work is not None:
                work.append(len(i) * (rest.stop - rest.start))
            return i, columns[j], score
    i, j = np.nonzero(alive)
    return i, columns[j], known[i, j]


def search(table: DataFrame, queries: DataFrame, *, k: int = K, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to smaller ids.

    ``table`` and ``queries`` are (id, v array<long>). A query's own id is no candidate. Only vectors of a query's
    length are candidates for it; with fewer than ``k`` all are returned. An id that repeats among the candidates is
    a candidate each time; a repeated query (same id and vector) is answered once. Empty tables give no rows; columns
    beside the two named aren't read, whatever their names.

    Candidates are packed in chunks and queries in blocks, and every chunk meets every block once in a phase.
    1. Each chunk lists, in one slice of the components (slices in turn), its k highest partial scores for each query, and resolves
       the whole scores of those it lists. The k-th highest of a query's, gathered over all chunks, is a safe cutoff.
    2. The cutoffs go to all chunks with the query blocks, which collect a sufficient set: candidates that the cutoff can't
       rule out by the slices known so far and a uniform bound on the missing ones.
    3. Only for these the missing slices are resolved exactly; those that reach the cutoff are gathered, the k best returned.
    Rows of one phase are at most k for each query and chunk. Phase 1 multiplies 1 / slices of all components, phases 2 and 3
    at most all of them once.
    """
    table, queries = cut(table), queries.distinct()
    n, nq = table.count(), queries.count()
    chunks, blocks = max(1, math.ceil(n / CHUNK)), max(1, math.ceil(nq / BLOCK))
    # Rows are dealt by their hash and place, so that no id or vector, however often it repeats, fills a chunk.
    deal = lambda f, m: F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(m)).cast("long")
    packed = cut(_packed(table.select(F.size("v").cast("long").alias("d"), deal(table, chunks).alias("c"), "id", "v"), ["d", "c"]))
    asked = cut(_packed(queries.select(F.size("v").cast("long").alias("d"), deal(queries, blocks).alias("b"), "id", "v"), ["d", "b"]))
    every = lambda f, name, m: f.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    # Each side is repeated for the other's parts, which Spark's size estimates miss: never through the driver as a broadcast.
    tiles = lambda q: every(packed, "b", blocks).hint("merge").join(every(q.withColumnsRenamed({"ids": "qids", "vs": "qvs"}), "c", chunks).hint("merge"), ["d", "c", "b"])
    none = np.iinfo(np.int64).min

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for ids, vs, qids, qvs, d, b, at in zip(*(r.column(x) for x in ("ids", "vs", "qids", "qvs", "d", "b", "c")), strict=True):
                (ci, c), (qi, q) = _matrix(ids, vs), _matrix(qids, qvs)
                own = _slices(c.shape[1], slices)
                s = own[at.as_py() % len(own)]
                part = np.where(ci[None, :] != qi[:, None], _products(q[:, s], c[:, s], _bound(q, c)), none)
                most = min(k, len(ci))
                top = np.argpartition(part, len(ci) - most, axis=1)[:, len(ci) - most :]
                row = np.repeat(np.arange(len(qi)), most)
                listed = top.ravel()
                other = ci[listed] != qi[row]
                row, listed = row[other], listed[other]
                score = (q[row] * c[listed]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d.as_py())), pa.array(np.full(len(row), b.as_py())), pa.array(row), pa.array(score)], ["d", "b", "row", "score"])

    gathered = tiles(asked).mapInArrow(lists, "d long, b long, row long, score long")
    by = Window.partitionBy("d", "b", "row").orderBy(F.desc("score"))
    cutoffs = gathered.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).groupBy("d", "b", "row").agg(F.min("score").alias("t"), F.count("*").alias("n"))
    safe = cutoffs.select("d", "b", F.struct("row", F.when(F.col("n") == k, F.col("t")).otherwise(F.lit(none)).alias("t")).alias("x")).groupBy("d", "b").agg(F.array_sort(F.collect_list("x")).alias("cutoffs"))

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for ids, vs, qids, qvs, cuts, d, b in zip(*(r.column(x) for x in ("ids", "vs", "qids", "qvs", "cutoffs", "d", "b")), strict=True):
                (ci, c), (qi, q) = _matrix(ids, vs), _matrix(qids, qvs)
                t = np.full(len(qi), none)
                for x in cuts.as_py() or []:
                    t[x["row"]] = x["t"]
                bound = _bound(q, c)
                if bound >= 2**58:  # sums may wrap, so no part of a score says anything about the whole
                    i, j, score = (x.ravel() for x in (*np.indices((len(qi), len(ci))), _products(q, c, bound)))
                else:
                    i, j, score = sufficient(q, c, t, _slices(c.shape[1], slices), bound)
                on = (ci[j] != qi[i]) & (score >= t[i])
                i, j, score = i[on], j[on], score[on]
                order = np.lexsort((ci[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                on = np.arange(len(i)) - first < k
                i, j, score = i[on], j[on], score[on]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d.as_py())), pa.array(np.full(len(i), b.as_py())), pa.array(i), pa.array(qi[i]), pa.array(ci[j]), pa.array(score)], ["d", "b", "row", "query_id", "vec_id", "score"])

    found = tiles(asked.join(safe.hint("merge"), ["d", "b"], "left")).mapInArrow(resolved, "d long, b long, row long, query_id long, vec_id long, score long")
    top = Window.partitionBy("d", "b", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_query(spark, sf_dir):
    vectors = quantised(load(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("id") % EVERY == 0))


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
