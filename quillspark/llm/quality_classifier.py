"""Document quality by regularised quadratic discriminant analysis over transformed text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text as T
from quillspark.llm._common import crc_mod, cut, load

#: The last three bytes classes hold letters beyond ASCII, blanks and everything else.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>{}[]=_~^\\/+@", "stop": b".,;:?'\"()-", "shout": b"!", "line": b"\n", "blank": b" \t\r\x0b\x0c"}
_CLASS = np.full(256, 9, dtype=np.uint8)
for _i, _b in enumerate(_CLASSES.values()):
    _CLASS[list(_b)] = _i
_CLASS[128:] = 8
N_CLASSES = 10

FEATURES = ("log_words", "log_word_length", "upper", "digit", "symbol", "stop", "shout", "line", "foreign", "other", "distinct", "repeated", "run", "top_word")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; null and empty texts give the row of no words.

    Shares are taken as log odds with half a count added, so that they are nearer to normal and finite.
    """
    out = np.zeros((len(texts), len(FEATURES)))
    for a, z, data, offsets in T.spans(texts):
        n = z - a
        rows = np.repeat(np.arange(n, dtype=np.int64) * N_CLASSES, np.diff(offsets))
        counts = np.bincount(rows + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
        w = T.words(data, offsets)
        n_words = np.diff(w.first).astype(float)
        solid = counts.sum(1) - counts[:, 6] - counts[:, 7]
        distinct, top = _distinct(w.hash, w.doc, n)
        tri = T.window_hash(w.hash, 3)
        inside = T.windows_inside(w.first, len(tri), 3)
        n_tri = np.maximum(0, n_words - 2)
        distinct_tri, _ = _distinct(tri[inside], w.doc[: len(tri)][inside], n)
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        runs = np.bincount(w.doc[1:][same], minlength=n)
        odds = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5)) - np.log(0.5 / (whole + 0.5)) * (whole == 0)
        f = out[a:z]
        f[:, 0] = np.log1p(n_words)
        f[:, 1] = np.log((solid + 1) / (n_words + 1))
        letters = counts[:, 0] + counts[:, 1]
        f[:, 2] = odds(counts[:, 0], letters)
        for j, c in ((3, 2), (4, 3), (5, 4), (6, 5), (8, 8), (9, 9)):
            f[:, j] = odds(counts[:, c], solid)
        f[:, 7] = odds(np.minimum(counts[:, 6], n_words), n_words)
        f[:, 10] = odds(distinct, n_words)
        f[:, 11] = odds(n_tri - distinct_tri, n_tri)
        f[:, 12] = odds(runs, n_words)
        f[:, 13] = odds(top, n_words)
    return out


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the commonest, in each document."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), kind="stable")
    d, x = doc[order], h[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(x))))
    return np.bincount(d[at], minlength=n).astype(float), top


@dataclass
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the covariance and its log determinant."""

    log_prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    temperature: float
    constant: float | None = None

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, *, shrink: float = 0.2, ridge: float = 0.05, temperature: float = 4.0) -> Discriminant:
        """From class counts, sums and sums of outer products.

        Each class covariance moves by ``shrink`` to the pooled one, and by ``ridge`` to the pooled diagonal. With
        fewer than two examples of a class every score is the smoothed share of label 1.
        """
        d = sums.shape[1]
        if min(n) < 2:
            z = np.zeros((2, d))
            return cls(np.zeros(2), z, np.stack([np.eye(d)] * 2), np.zeros(2), temperature, float((n[1] + 1) / (n.sum() + 2)))
        mean = sums / n[:, None]
        own = squares / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (own * n[:, None, None]).sum(0) / n.sum()
        scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
        cov = (1 - shrink) * own + shrink * pooled + ridge * scale
        factor = np.linalg.cholesky(cov)
        return cls(np.log(n / n.sum()), mean, factor, 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1), temperature)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for k in (0, 1):
            y = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            logs.append(self.log_prior[k] - 0.5 * self.log_det[k] - 0.5 * (y * y).sum(0))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / self.temperature, -700, 700)))


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), flat], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, "id long, x array<double>")


def fit(examples: DataFrame, **options) -> Discriminant:
    """``examples``: (label int 0/1, x). Each task adds up its rows' moments; the driver gets their sums only."""
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(1).flatten()).reshape(len(y), d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        size = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size).astype(np.int32)), pa.array(np.tile(np.arange(size), 2).astype(np.int32)), pa.array(total.ravel())], ["k", "i", "v"])

    found = np.zeros((2, 1 + d + d * d))
    for r in examples.select(F.col("label").cast("int"), "x").mapInArrow(moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        found[r.k, r.i] = r.v
    return Discriminant.fit(found[:, 0], found[:, 1 : 1 + d], found[:, 1 + d :].reshape(2, d, d), **options)


def score_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    The model sees the labels of rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``, all of them, and
    nothing of a document but its text. Null text scores as the empty text does. Labels that are null or not 0 or 1
    are passed over; a document with several labels is an example for each. Rows that repeat get equal scores. A
    null id is in no fold, so it is never held out. Without examples of both labels the score is the smoothed share
    of label 1. Only (id, 14 numbers) a document is kept between the steps.
    """
    x = cut(document_statistics(docs.select("doc_id", "text")))
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("label")).where(F.col("label").isin(0, 1) & (crc_mod(F.col("id"), folds) != held_out))
    model = fit(x.join(y, "id"), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.asarray(b.column(2).flatten()).reshape(b.num_rows, len(FEATURES))
            s = model.score(got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.select("id", (crc_mod(F.col("id"), folds) == held_out).alias("out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_query(spark, sf_dir):
    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
