"""Column builders for scores: all of them stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 1e-9
LOG_EPSILON = 1e-12


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def clip_probability(p: Column) -> Column:
    return clip(p, EPSILON, 1.0 - EPSILON)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -700.0, 700.0)))


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.ln(q / (1.0 - q))


def whole(*keys: str) -> WindowSpec:
    """All rows of a group."""
    return Window.partitionBy(*keys)


def ordered(keys: list[str], *by: Column) -> WindowSpec:
    """The rows of a group up to the current one."""
    return Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def softmax(x: Column, temperature: float, over: WindowSpec) -> Column:
    e = softmax_weight(x, temperature, over)
    return e / F.sum(e).over(over)


def softmax_weight(x: Column, temperature: float, over: WindowSpec) -> Column:
    return F.exp(clip((x - F.max(x).over(over)) / temperature, -80.0, 80.0))


def log_sum_exp(values: Column) -> Column:
    """Over an array of a group's log likelihoods; null for an empty one."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def normalised_entropy(p: Column, over: WindowSpec) -> Column:
    """In [0, 1]; 0 for a single candidate."""
    n = F.count(F.lit(1)).over(over)
    raw = -F.sum(p * F.ln(p + LOG_EPSILON)).over(over)
    return F.when(n <= 1, F.lit(0.0)).otherwise(clip(raw / F.ln(F.greatest(n, F.lit(2)).cast("double")), 0.0, 1.0))




def error_rate(edits: Column, reference_units: Column, hypothesis_units: Column) -> Column:
    """edits / reference length; with an empty reference 0 if the hypothesis is empty too, else undefined (null)."""
    return F.when(reference_units > 0, edits / reference_units).when(hypothesis_units == 0, F.lit(0.0))
