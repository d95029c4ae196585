"""Contracts on scores: which may be added up, how likelihoods become preferences and utilities, what a risk gate permits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S

# Shares of runtime pressures; shares of candidates, of the budget and of actions that a throttle level leaves.
PRESSURE = {"latency_ratio": 0.34, "memory_pressure": 0.26, "queue_pressure": 0.18, "thermal_pressure": 0.16, "battery_saver": 0.06}
LEFT = {"maximum_candidates": (1.0, 0.75, 0.50, 0.25), "evidence_budget_ms": (1.0, 0.60, 0.25, 0.0), "maximum_evidence_actions": (1.0, 0.75, 0.50, 0.0)}
#: Levels from which a feature is off.
OFF_AT = {"enable_neural_reranker": 3, "enable_acoustic_verifier": 2, "enable_second_ear": 2, "enable_offline_teacher": 1}


def score_domains(scores: DataFrame, key: str) -> DataFrame:
    """(key, domain, problem) for each group of (key, semantics, domain, normalization): problem is null where the group's
    scores may be aggregated, and domain is theirs."""
    per = scores.groupBy(key).agg(
        F.count_distinct("semantics").alias("s"), F.count_if(F.col("domain").isNull()).alias("unknown"), F.count_distinct("domain").alias("d"),
        F.count_distinct(F.coalesce("normalization", F.lit("\u0000"))).alias("n"), F.min("domain").alias("domain"),
    )
    problem = (
        F.when(F.col("s") != 1, F.lit("scores with different semantics")).when(F.col("unknown") > 0, F.lit("score without a domain"))
        .when(F.col("d") != 1, F.lit("scores from different domains")).when(F.col("n") != 1, F.lit("scores with different normalization"))
    )
    return per.select(key, F.when(problem.isNull(), F.col("domain")).alias("domain"), problem.alias("problem"))


def require_same_domain(scores: DataFrame, key: str) -> DataFrame:
    """``scores``, but a group whose scores may not be aggregated raises when it is met."""
    judged = score_domains(scores, key).select(F.col(key).alias("_key"), F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": "), F.col("problem")))).otherwise(F.lit(True)).alias("_fine"))
    return scores.join(judged, scores[key].eqNullSafe(F.col("_key"))).where("_fine").drop("_key", "_fine")


def preferences(rows: DataFrame, key: str, value: str, *, temperature: float = 1.0) -> DataFrame:
    """Adds ``preference``: likelihoods of a group as shares of their exponentials, exponents held to 80 either way."""
    if not math.isfinite(temperature) or temperature <= 0:
        raise ValueError("the temperature is positive and finite")
    w = S.whole(key)
    mass = F.exp(F.greatest(F.lit(-80.0), F.least(F.lit(80.0), (F.col(value) - F.max(value).over(w)) / temperature)))
    return rows.withColumn("preference", mass).withColumn("preference", F.col("preference") / F.sum("preference").over(w))


def sequence_log_probability(logits: Column, labels: Column, *, ignore: int = -100) -> dict[str, Column]:
    """Sum, mean and count of the labels' log-softmaxes, rows with the ignored label left out; a label outside its row raises."""
    def one(row: Column, label: Column) -> Column:
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        inside = F.when((label >= 0) & (label < F.size(row)), F.get(row, label)).otherwise(F.raise_error(F.lit("a label outside the vocabulary")).cast("double"))
        return F.when(label != ignore, inside - top - F.ln(total))

    each = F.filter(F.zip_with(logits, labels, one), lambda x: x.isNotNull())
    total, n = F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size(each)
    return {"sum_logprob": F.when(n > 0, total), "average_logprob": F.try_divide(total, n), "token_count": n}


def bounded_utility(value: Column, *, center: float, scale: float, higher_is_better: bool = True) -> Column:
    """tanh((value - center) / scale), turned round where lower is better."""
    return F.tanh((value - center) * (1.0 if higher_is_better else -1.0) / scale)


def length_normalised(total: Column, tokens: Column, *, center: float, scale: float, by_length: bool = True) -> Column:
    """A document's log-likelihood, a token each if ``by_length``, as a bounded score."""
    return F.tanh(((total / tokens if by_length else total) - center) / scale)


def risk_permits(rows: DataFrame, *, maximum_risk: float, minimum_coverage: float, minimum_samples: int, verified: bool) -> Column:
    """Whether held-out risk, coverage and samples, and a decision's posterior mass, permit accepting it without a look."""
    out_of_range = ~(F.col("empirical_risk").between(0, 1) & F.col("empirical_coverage").between(0, 1))
    fine = (F.col("empirical_risk") <= maximum_risk) & (F.col("empirical_coverage") >= minimum_coverage) & (F.col("cumulative_posterior") >= minimum_coverage)
    enough = F.lit(verified) & (F.col("sample_count") >= minimum_samples)
    return F.when(~enough, F.lit(False)).when(out_of_range, F.raise_error(F.lit("risk and coverage lie between 0 and 1")).cast("boolean")).otherwise(fine)


def pressure_score() -> Column:
    latency = F.least(F.lit(2.0), F.col("latency_ratio")) / 2.0
    part = {c: F.least(F.lit(1.0), F.col(c)) for c in PRESSURE} | {"latency_ratio": latency, "battery_saver": F.col("battery_saver").cast("double")}
    total = F.lit(0.0)
    for c, share in PRESSURE.items():
        total = total + share * part[c]
    return F.least(F.lit(1.0), total)


def throttled_effort(rows: DataFrame) -> DataFrame:
    """What a throttle ``level`` (0 to 3) leaves of an effort profile, and why, for rows of profile and pressures.

    Halves round to even. At least one candidate stays.
    """
    scaled = {c: F.bround(F.col(c) * F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("level") + 1)).cast("long") for c, shares in LEFT.items()}
    scaled["maximum_candidates"] = F.greatest(F.lit(1), scaled["maximum_candidates"])
    flags = {c: F.col(c) & (F.col("level") < level) for c, level in OFF_AT.items()}
    reasons = F.array_compact(F.array(
        F.when(F.col("latency_ratio") >= 1.0, F.lit("latency-over-target")), F.when(F.col("memory_pressure") >= 0.75, F.lit("memory-pressure")), F.when(F.col("queue_pressure") >= 0.75, F.lit("queue-pressure")),
        F.when(F.col("thermal_pressure") >= 0.75, F.lit("thermal-pressure")), F.when(F.col("battery_saver"), F.lit("battery-saver")), F.when(F.col("level") > 0, F.concat(F.lit("throttle-level-"), F.col("level").cast("string"))),
    ))
    return rows.withColumns({"pressure": pressure_score(), "reasons": reasons}).withColumns(scaled | flags)
