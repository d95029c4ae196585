"""Learning operators: sufficient statistics are summed by Spark, small systems are solved on the driver."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S


@dataclass
class Standardiser:
    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, rows: DataFrame, names: list[str], floor: float = 1e-6) -> Standardiser:
        """Population mean and deviation (at least ``floor``) of each feature, in one pass."""
        r = rows.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)]).first()
        return cls({n: float(r[f"m{i}"] or 0.0) for i, n in enumerate(names)}, {n: max(floor, float(r[f"s{i}"] or 0.0)) for i, n in enumerate(names)})

    def column(self, name: str) -> Column:
        return (F.coalesce(F.col(name).cast("double"), F.lit(self.means[name])) - self.means[name]) / self.scales[name]


def ridge(rows: DataFrame, names: list[str], target: str, penalty: float = 1.0) -> dict[str, float]:
    """Weights and intercept (``""``) by the normal equations: the Gram matrix is a set of sums, whatever the rows."""
    cols = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    d = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(c * F.col(target)).alias(f"t{i}") for i, c in enumerate(cols)]
    r = rows.where(F.col(target).isNotNull()).agg(*sums).first()
    gram = np.array([[float(r[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(d)] for i in range(d)])
    gram[np.arange(1, d), np.arange(1, d)] += penalty
    gram[0, 0] += 1e-12
    w = np.linalg.solve(gram, np.array([float(r[f"t{i}"] or 0) for i in range(d)]))
    return dict(zip(["", *names], w.tolist(), strict=True))


def fit_planner(observations: DataFrame, names: list[str], *, minimum: int = 12, penalty: float = 1.0) -> dict[str, dict]:
    """Per action two regressions, of gain and of log(1 + cost); under ``minimum`` samples their means."""
    out = {}
    for r in observations.groupBy("action").agg(F.count("*").alias("n"), F.avg("gain").alias("g"), F.avg(F.log1p("cost")).alias("c")).collect():  # a row an action
        own = observations.where(F.col("action") == r.action).withColumn("_c", F.log1p("cost"))
        out[r.action] = {"gain": {"": r.g}, "cost": {"": r.c}} if r.n < minimum else {"gain": ridge(own, names, "gain", penalty), "cost": ridge(own, names, "_c", penalty)}
    return out


def platt(rows: DataFrame, *, l2: float = 1e-3, rounds: int = 50, tolerance: float = 1e-9, minimum_slope: float = 1e-6) -> tuple[float, float]:
    """(slope, intercept) of P(correct) = sigmoid(slope * score + intercept), by damped Newton steps.

    Each step is one aggregation of gradient, curvature and loss; the slope stays positive.
    """
    rows = rows.select(F.col("score").cast("double").alias("x"), F.col("correct").cast("double").alias("y")).cache()
    n = rows.count()
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * F.col("x") + b
        return float(rows.agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("y") * z).alias("v")).first().v or 0.0) + l2 / 2 * ((a - 1) ** 2 + b * b)

    now = loss(a, b) if n else 0.0
    for _ in range(rounds if n else 0):
        p = S.sigmoid(a * F.col("x") + b)
        e, h = p - F.col("y"), p * (1 - p)
        r = rows.agg(*[F.avg(v).alias(k) for k, v in {"ga": e * F.col("x"), "gb": e, "haa": h * F.col("x") * F.col("x"), "hab": h * F.col("x"), "hbb": h}.items()]).first()
        g = np.array([r.ga + l2 * (a - 1), r.gb + l2 * b])
        step = np.linalg.solve(np.array([[r.haa + l2, r.hab], [r.hab, r.hbb + l2]]), g)
        scale = 1.0
        while scale > 1e-6:
            na, nb = max(minimum_slope, a - scale * step[0]), b - scale * step[1]
            new = loss(na, nb)
            if new <= now:
                break
            scale /= 2
        if scale <= 1e-6 or abs(now - new) < tolerance:
            break
        a, b, now = na, nb, new
    rows.unpersist()
    return a, b


def _pool(blocks: list[list[float]], x: float, w: float, y: float) -> None:
    """Add a block at the end and pool it with those before whose mean isn't below its own."""
    blocks.append([x, w, y])
    while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
        x, w, y = blocks.pop()
        blocks[-1] = [x, blocks[-1][1] + w, blocks[-1][2] + y]


def isotonic(rows: DataFrame) -> list[tuple[float, float]]:
    """(upper threshold, probability) blocks by pooling adjacent violators; prediction is a step function.

    Equal scores are added up by Spark and pooled within range partitions; the driver pools the blocks that are left.
    """
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    per = rows.groupBy(F.col("score").cast("double").alias("x")).agg(F.sum(weight).cast("double").alias("w"), F.sum(weight * F.col("correct").cast("double")).alias("y"))

    def pool(batches: Iterator) -> Iterator:
        import pandas as pd

        blocks: list[list[float]] = []
        for batch in batches:
            for x, w, y in batch.itertuples(index=False):
                _pool(blocks, x, w, y)
        yield pd.DataFrame(blocks, columns=["x", "w", "y"], dtype="float64")

    blocks: list[list[float]] = []
    parts = per.where("x is not null").repartitionByRange("x").sortWithinPartitions("x").mapInPandas(pool, "x double, w double, y double")
    for r in sorted(parts.collect()):
        _pool(blocks, r.x, r.w, r.y)
    return [(x, y / w) for x, w, y in blocks]


def isotonic_column(score: Column, blocks: list[tuple[float, float]]) -> Column:
    """The first block whose threshold reaches the score, else the last; the blocks are one literal of the plan."""
    table = F.from_json(F.lit(json.dumps([{"x": x, "p": p} for x, p in blocks])), "array<struct<x: double, p: double>>")
    return F.coalesce(F.get(F.filter(table, lambda b: b["x"] >= score), F.lit(0))["p"], F.lit(blocks[-1][1]))


@dataclass
class LinearRanker:
    weights: dict[str, float]
    standard: Standardiser
    history: list[float] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(0.0)
        for n, w in self.weights.items():
            total = total + w * self.standard.column(n)
        return total


def _groups(rows: DataFrame, names: list[str], standard: Standardiser, bound: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """At most ``bound`` groups (those of least hash) as matrices: training runs on a bounded, documented sample."""
    picked = rows.select("group_id").distinct().orderBy(F.xxhash64("group_id"), "group_id").limit(bound)
    got: dict = {}
    for r in rows.join(picked, "group_id").select("group_id", "candidate_id", F.col("loss").cast("double").alias("loss"), *[standard.column(n).alias(n) for n in names]).orderBy("group_id", "candidate_id").collect():
        got.setdefault(r.group_id, []).append(([r[n] for n in names], r.loss))
    return [(np.array([x for x, _ in g]), np.array([y for _, y in g])) for g in got.values() if len(g) > 1]


def train_pairwise(rows: DataFrame, names: list[str], *, epochs: int = 80, rate: float = 0.08, l2: float = 0.002, gap: float = 1e-6, seed: int = 17, sample_groups: int = 5_000) -> LinearRanker:
    """Logistic loss on pairs of a group whose losses differ by more than ``gap``, seeded order, decaying rate."""
    standard = Standardiser.fit(rows, names)
    pairs = []
    for x, y in _groups(rows, names, standard, sample_groups):
        i, j = np.triu_indices(len(y), 1)
        keep = np.abs(y[i] - y[j]) > gap
        sign = np.where(y[i] < y[j], 1.0, -1.0)[keep]
        pairs.append((x[i[keep]] - x[j[keep]]) * sign[:, None])
    data, w, rng, history = (np.concatenate(pairs) if pairs else np.zeros((0, len(names)))), np.zeros(len(names)), random.Random(seed), []
    for epoch in range(epochs if len(data) else 0):
        order = list(range(len(data)))
        rng.shuffle(order)
        step, total = rate / math.sqrt(1 + 0.05 * epoch), 0.0
        for k in order:
            z = float(data[k] @ w)
            total += math.log1p(math.exp(-abs(z))) + max(-z, 0.0)
            w += step * (data[k] / (1 + math.exp(min(z, 700))) - l2 * w)
        history.append(total / len(data))
    return LinearRanker(dict(zip(names, w.tolist(), strict=True)), standard, history)


def train_listwise(rows: DataFrame, names: list[str], *, epochs: int = 160, rate: float = 0.05, l2: float = 0.002, temperature: float = 1.0, clip: float = 5.0, signs: dict[str, int] | None = None, sample_groups: int = 5_000) -> LinearRanker:
    """Expected loss under each group's softmax, by clipped gradient steps; ``signs`` fixes the sign of some weights."""
    standard = Standardiser.fit(rows, names)
    groups, w, history = _groups(rows, names, standard, sample_groups), np.zeros(len(names)), []
    side = np.array([(signs or {}).get(n, 0) for n in names])
    for epoch in range(epochs if groups else 0):
        g, total = l2 * w, 0.0
        for x, y in groups:
            e = np.exp((x @ w - (x @ w).max()) / temperature)
            p = e / e.sum()
            mean = float(p @ y)
            g = g + ((p * (y - mean)) @ x) / temperature / len(groups)
            total += mean
        norm = float(np.linalg.norm(g))
        w = w - rate / math.sqrt(1 + 0.02 * epoch) * len(names) * (g * (clip / norm) if norm > clip else g)
        w = np.where((side > 0) & (w < 0) | (side < 0) & (w > 0), 0.0, w)
        history.append(total / len(groups))
    return LinearRanker(dict(zip(names, w.tolist(), strict=True)), standard, history)


def target_distribution(rows: DataFrame, *, sharpness: float = 8.0) -> DataFrame:
    """Adds ``target``: exp(-sharpness * (loss - least loss of the group)), normalised, where none is given."""
    w = S.whole("group_id")
    raw = F.exp(-sharpness * (F.col("loss") - F.min("loss").over(w)))
    derived = raw / F.sum(raw).over(w)
    return rows.withColumn("target", F.coalesce(F.col("target"), derived) if "target" in rows.columns else derived)


def on_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative coordinates that add up to one."""
    u = np.sort(v)[::-1]
    k = np.arange(1, len(v) + 1)
    shift = (np.cumsum(u) - 1) / k
    return np.maximum(v - shift[np.flatnonzero(u > shift)[-1]], 0.0)


def train_fusion(rows: DataFrame, start: dict[str, float], family: tuple[str, ...], *, floor: float = 0.72, epochs: int = 200, rate: float = 0.08, pull: float = 0.02, temperature: float = 0.18, sample_groups: int = 5_000) -> dict[str, float]:
    """Stream weights by gradient steps on the cross-entropy of ``target``, kept on the simplex with the family's floor.

    ``rows``: (group_id, candidate_id, streams on [0, 1], target). ``pull`` draws back to the starting weights.
    """
    names = list(start)
    w0 = np.array([start[n] for n in names])
    w0 = w0 / w0.sum()
    own = np.array([n in family for n in names])
    rows = rows.withColumn("loss", F.col("target"))
    groups = _groups(rows, names, Standardiser(dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)), sample_groups)
    w = w0.copy()
    for epoch in range(epochs if groups else 0):
        g = 2 * pull * (w - w0)
        for x, t in groups:
            e = np.exp((x @ w - (x @ w).max()) / temperature)
            g = g + x.T @ (e / e.sum() - t) / temperature / len(groups)
        w = on_simplex(w - rate / math.sqrt(1 + 0.05 * epoch) * g)
        held = w[own].sum()
        if held < floor:
            w[own] = w[own] * floor / held if held > 0 else floor / own.sum()
            rest = w[~own].sum()
            w[~own] = w[~own] * (1 - floor) / rest if rest > 0 else (1 - floor) / max(1, (~own).sum())
    return dict(zip(names, w.tolist(), strict=True))


def evaluate_ranker(rows: DataFrame, score: str) -> DataFrame:
    """One row: share of pairs of a group, with different losses, that the score orders rightly, and mean loss of the best."""
    a, b = rows.select("group_id", F.col("candidate_id").alias("i"), F.col("loss").alias("li"), F.col(score).alias("si")), rows.select("group_id", F.col("candidate_id").alias("j"), F.col("loss").alias("lj"), F.col(score).alias("sj"))
    pairs = a.join(b, "group_id").where("i < j and li <> lj").agg(F.count("*").alias("pairs"), F.avg(((F.col("si") > F.col("sj")) == (F.col("li") < F.col("lj"))).cast("double")).alias("accuracy"))
    best = rows.groupBy("group_id").agg(F.max_by("loss", F.struct(score, "candidate_id")).alias("l")).agg(F.avg("l").alias("mean_loss"))
    return pairs.crossJoin(best)
