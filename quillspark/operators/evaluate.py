"""Error rates, calibration measures and paired statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as X

TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of two texts that are already folded and without white space."""
    return S.error_rate(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis))


def pattern_error_rate(reference: Column, hypothesis: Column, pattern: str) -> Column:
    """Error rate over the sequences of a pattern's matches: numbers, dates, amounts, negations, entities."""
    r, h = X.matches(reference, pattern), X.matches(hypothesis, pattern)
    return S.error_rate(X.array_edit_distance(r, h), F.size(r), F.size(h))


def exact_cer(annotated: Column, hypothesis: Column) -> Column:
    """On the spoken surface of an annotated reference; undefined if parts of it are uncertain or masked."""
    counts = X.annotation_counts(annotated)
    surface = X.collapsed(X.spoken_surface(annotated))
    return F.when((counts["uncertain"] == 0) & (counts["masked"] == 0) & (F.length(surface) > 0), cer(surface, X.collapsed(hypothesis)))


def corpus_and_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (units, edits, rate): the mean of rates and the rate of totals can point in opposite directions; both."""
    defined = F.col("rate").isNotNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("rate").alias("defined"), F.avg("rate").alias("utterance_mean"), F.try_divide(F.sum(F.when(defined, F.col("edits"))), F.sum(F.when(defined, F.col("units")))).alias("corpus_rate"))


def oracle_at_k(rows: DataFrame) -> DataFrame:
    """Adds the least error rate among a sample's candidates up to each position; never rises with k."""
    return rows.withColumn("oracle", F.min("rate").over(Window.partitionBy("sample_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def slices(rows: DataFrame, labels: dict[str, Column], measures: list[Column]) -> DataFrame:
    """Measures for each label; a row counts under every label whose predicate it meets."""
    tags = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in labels.items()]))
    return rows.withColumn("slice", F.explode(tags)).groupBy("slice").agg(*measures)


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(ece, brier, nll, n) of (p, y): bins are [i/bins, (i+1)/bins), the last one closed."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    own = F.size(F.filter(edges, lambda e: F.col("p") >= e))
    q = S.clip_probability(F.col("p"))
    y = F.col("y").cast("double")
    per = rows.withColumns({"bin": own, "b": (q - y) * (q - y), "l": -(y * F.ln(q) + (1 - y) * F.ln(1 - q))}).groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(y).alias("y"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    return per.agg(F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("ece"), F.try_divide(F.sum("b"), F.sum("n")).alias("brier"), F.try_divide(F.sum("l"), F.sum("n")).alias("nll"), F.sum("n").alias("n"))


def _by_rank(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """Adds each row's place ``at`` and the running sum ``run`` of ``value`` in a global order, without one task for all.

    Range partitioning deals the order out; each part's totals (a row a part) give the offsets.
    """
    parts = rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    from quillspark.sources.sinks import settle

    parts = settle(parts)
    totals = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    before = totals.alias("t").join(totals.alias("u"), F.col("u._part") < F.col("t._part"), "left").groupBy(F.col("t._part").alias("_part")).agg(F.coalesce(F.sum("u._n"), F.lit(0)).alias("_n0"), F.coalesce(F.sum("u._s"), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumns({"_i": F.count(F.lit(1)).over(w), "_r": F.sum("_v").over(w)}).join(F.broadcast(before), "_part")
    return out.withColumns({"at": F.col("_i") + F.col("_n0"), "run": F.col("_r") + F.col("_s0")}).drop("_v", "_part", "_i", "_r", "_n0", "_s0")


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(coverage, risk) after each row (id, confidence, correct), by falling confidence, ties by id."""
    n = rows.count()
    ranked = _by_rank(rows, [F.desc("confidence"), F.asc("id")], (~F.col("correct")).cast("long"))
    return ranked.select("id", "at", (F.col("at") / n).alias("coverage"), (F.col("run") / F.col("at")).alias("risk"))


def area_under_risk_coverage(rows: DataFrame) -> DataFrame:
    """Trapezoids under the curve, which starts at (0, 0): each point's risk counts for the steps at both its sides."""
    curve = risk_coverage(rows)
    n = F.count("*")
    last = F.max(F.when(F.col("coverage") == 1.0, F.col("risk")))
    return curve.agg(((F.sum("risk") - last / 2) / n).alias("aurc"), n.alias("n"))


def temperature_grid(rows: DataFrame, grid: tuple[float, ...] = TEMPERATURES) -> DataFrame:
    """(temperature, nll) of (p, y) for each temperature of a fixed grid, and whether it is the best (ties: the lower)."""
    tried = rows.withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in grid])))
    q = S.clip_probability(S.sigmoid(S.logit(F.col("p")) / F.col("temperature")))
    y = F.col("y").cast("double")
    out = tried.groupBy("temperature").agg((-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("nll"))
    return out.withColumn("best", F.row_number().over(Window.orderBy("nll", "temperature")) == 1)  # as many rows as the grid


def learn_then_test(rows: DataFrame, *, target: float = 0.10, delta: float = 0.05, minimum_groups: int = 30) -> DataFrame:
    """Per k of (k, group_id, loss, cost): mean loss of group means, a Hoeffding bound shared over all k, acceptance.

    ``selected`` marks the accepted k of least cost, then least k.
    """
    per = rows.groupBy("k", "group_id").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"), F.sum("cost").alias("cost"))
    k = per.groupBy("k").agg(F.sum("n").alias("samples"), F.count("*").alias("groups"), F.avg("loss").alias("risk"), (F.sum("cost") / F.sum("n")).alias("mean_cost"))
    k = k.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))  # one row for each k from here on
    radius = F.sqrt(F.ln(F.col("_m") / delta) / (2.0 * F.col("groups")))
    k = k.withColumn("upper", F.when(F.col("groups") >= minimum_groups, F.least(F.lit(1.0), F.col("risk") + radius)).otherwise(F.lit(1.0)))
    k = k.withColumn("accepted", (F.col("groups") >= minimum_groups) & (F.col("upper") <= target))
    first = F.row_number().over(Window.orderBy(F.desc("accepted"), "mean_cost", "k")) == 1
    return k.withColumn("selected", first & F.col("accepted")).drop("_m")


def policy_bounds(policies: DataFrame, outcomes: DataFrame, *, target: float, delta: float = 0.05, minimum: int = 30) -> DataFrame:
    """Per policy of (policy_id, candidate_count): bounded mean loss of its outcomes (policy_id, loss, cost), pass, place.

    A policy without outcomes, or outcomes of an unknown policy, are errors in the data and raise when they are met.
    """
    per = outcomes.groupBy("policy_id").agg(F.count("*").alias("samples"), F.avg("loss").alias("risk"), F.avg("cost").alias("mean_cost"))
    both = policies.join(per, "policy_id", "full").withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    fine = F.col("samples").isNotNull() & F.col("candidate_count").isNotNull()
    both = both.withColumn("samples", F.when(fine, F.col("samples")).otherwise(F.raise_error(F.concat(F.lit("policy without outcomes or unknown: "), F.col("policy_id")))))
    both = both.withColumn("upper", F.least(F.lit(1.0), F.col("risk") + F.sqrt(F.ln(F.col("_m") / delta) / (2.0 * F.col("samples")))))
    both = both.withColumn("passed", (F.col("samples") >= minimum) & (F.col("upper") <= target))
    place = F.row_number().over(Window.orderBy(F.desc("passed"), "mean_cost", "candidate_count", "policy_id"))
    return both.withColumn("place", F.when(F.col("passed"), place)).drop("_m")


def pareto(points: DataFrame, larger: list[str], smaller: list[str], key: str) -> DataFrame:
    """Points that no other is at least as good as in every column and better in one.

    For two columns use ``pareto_sorted``; this one compares pairs and is for families of policies or models.
    """
    a, b = points.alias("a"), points.alias("b")
    weak, strict = F.lit(True), F.lit(False)
    for c in larger:
        weak, strict = weak & (F.col(f"b.{c}") >= F.col(f"a.{c}")), strict | (F.col(f"b.{c}") > F.col(f"a.{c}"))
    for c in smaller:
        weak, strict = weak & (F.col(f"b.{c}") <= F.col(f"a.{c}")), strict | (F.col(f"b.{c}") < F.col(f"a.{c}"))
    return a.join(b, weak & strict & (F.col(f"a.{key}") != F.col(f"b.{key}")), "left_anti")


def pareto_sorted(points: DataFrame, *, cost: str, quality: str, group: str) -> DataFrame:
    """Two-column frontier within each group: by rising cost, those whose quality is above all cheaper ones'.

    Of points with equal cost only the best stay, all of them if they tie.
    """
    best = points.groupBy(group, cost).agg(F.max(quality).alias("_best"))
    cheaper = Window.partitionBy(group).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_cheaper", F.max("_best").over(cheaper)).where(F.col("_cheaper").isNull() | (F.col("_best") > F.col("_cheaper")))
    return points.join(best, [group, cost]).where(F.col(quality) == F.col("_best")).drop("_best", "_cheaper")


def boundary_diagnostics(rows: DataFrame) -> DataFrame:
    """By system: error rate of the best windows, edits that strict rates count beyond it, rows and characters that overrun.

    ``rows``: (system, reference_characters, strict_rate, edits, prefix, suffix); the last three are null where a row wasn't aligned.
    """
    aligned = F.col("edits").isNotNull()
    strict = F.rint(F.coalesce(F.sum(F.when(F.col("reference_characters") > 0, F.col("strict_rate") * F.col("reference_characters"))), F.lit(0.0))).cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(aligned, F.col(c))), F.lit(0)).cast("long")
    return rows.groupBy("system").agg(
        F.try_divide(total("edits"), F.nullif(total("reference_characters"), F.lit(0))).alias("aligned_rate"), F.greatest(F.lit(0).cast("long"), strict - total("edits")).alias("edit_reduction"),
        F.count_if(aligned & ((F.col("prefix") > 0) | (F.col("suffix") > 0))).alias("overrun_rows"), F.count_if(aligned & (F.col("prefix") > 0)).alias("prefix_rows"), total("prefix").alias("prefix_characters"),
        F.count_if(aligned & (F.col("suffix") > 0)).alias("suffix_rows"), total("suffix").alias("suffix_characters"),
    )


def paired_cohort(results: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(sample_id, group_id, baseline, candidate) of two systems; a sample that one of them lacks raises."""
    a = results.where(F.col("system") == baseline).select("sample_id", F.col("group_id").alias("g1"), F.col("value").alias("baseline"))
    b = results.where(F.col("system") == candidate).select("sample_id", F.col("group_id").alias("g2"), F.col("value").alias("candidate"))
    whole = F.col("baseline").isNotNull() & F.col("candidate").isNotNull()
    return a.join(b, "sample_id", "full").select("sample_id", F.when(whole, F.coalesce("g1", "g2")).otherwise(F.raise_error(F.concat(F.lit("no counterpart for sample "), F.col("sample_id").cast("string")))).alias("group_id"), "baseline", "candidate")


def group_totals(rows: DataFrame) -> DataFrame:
    """Counts (group_id, reference_units, baseline_errors, candidate_errors) added up before any resampling."""
    return rows.groupBy("group_id").agg(*[F.sum(c).alias(c) for c in ("reference_units", "baseline_errors", "candidate_errors")])


def paired_bootstrap(rows: DataFrame, *, iterations: int = 2000, confidence: float = 0.95, seed: int = 17, most_groups: int = 1_000_000) -> DataFrame:
    """One row: corpus delta of error rates, its interval over resampled groups, share of resamples that are better.

    Groups are resampled with the Mersenne twister in order of group_id, as the published protocol does, so the
    group totals (one row a group, added up by Spark) meet in one task. Beyond ``most_groups`` groups it raises:
    ``poisson_bootstrap`` keeps groups where they are.
    """
    totals = group_totals(rows).select(F.col("group_id").cast("string"), *[F.col(c).cast("long") for c in ("reference_units", "baseline_errors", "candidate_errors")])

    def resample(batches: Iterator) -> Iterator:
        import random

        import pandas as pd

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n > most_groups:
                raise ValueError(f"over {most_groups} groups: resample with poisson_bootstrap")
        data = pd.concat(held).sort_values("group_id")
        units, left, right = (data[c].tolist() for c in ("reference_units", "baseline_errors", "candidate_errors"))
        rng, n, deltas = random.Random(seed), len(units), []
        for _ in range(iterations):
            picked = [rng.randrange(n) for _ in range(n)]
            total = sum(units[i] for i in picked)
            deltas.append((sum(right[i] for i in picked) - sum(left[i] for i in picked)) / total if total else 0.0)
        deltas.sort()
        tail = (1 - confidence) / 2

        def at(q: float) -> float:
            x = q * (len(deltas) - 1)
            lo = math.floor(x)
            hi = min(lo + 1, len(deltas) - 1)
            return deltas[lo] + (deltas[hi] - deltas[lo]) * (x - lo)

        total = sum(units)
        yield pd.DataFrame([{"groups": n, "delta": (sum(right) - sum(left)) / total if total else 0.0, "lower": at(tail), "upper": at(1 - tail), "better": sum(d < 0 for d in deltas) / len(deltas)}])

    return totals.coalesce(1).mapInPandas(resample, "groups long, delta double, lower double, upper double, better double")


def poisson_bootstrap(rows: DataFrame, *, iterations: int = 200, seed: int = 17) -> DataFrame:
    """(iteration, delta): each group weighs Poisson(1) in each iteration, by a hash, so that groups stay distributed."""
    totals = group_totals(rows)
    draws = totals.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "group_id", "iteration"), 11).cast("double") + 0.5) / float(1 << 53)
    weight, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k + 1
    w = draws.withColumn("w", weight)
    return w.groupBy("iteration").agg(F.try_divide(F.sum(F.col("w") * (F.col("candidate_errors") - F.col("baseline_errors"))), F.sum(F.col("w") * F.col("reference_units"))).alias("delta"))


def claim_gate(rows: DataFrame, *, maximum_critical: float = 0.0, maximum_latency: float = 2.0, minimum_better: float = 0.95) -> DataFrame:
    """Reasons against the claim that a candidate is better: (groups, lower, upper, better, critical_delta, latency_ratio)."""
    r = [
        F.when(F.col("groups") < 2, F.lit("insufficient-independent-resampling-units")), F.when(F.col("upper") >= 0, F.lit("paired-confidence-interval-does-not-show-improvement")),
        F.when(F.col("better") < minimum_better, F.lit("bootstrap-better-probability-below-threshold")), F.when(F.col("critical_delta") > maximum_critical, F.lit("critical-metric-regression")),
        F.when(F.col("latency_ratio") > maximum_latency, F.lit("latency-ratio-exceeds-threshold")),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*r))).withColumn("passed", F.size("reasons") == 0)


#: Metric, reason, and by how much it may get worse (as a difference, or as a ratio).
REGRESSIONS = {
    "top1_accuracy": ("top1-accuracy-regression", -0.005), "pairwise_accuracy": ("pairwise-accuracy-regression", -0.010), "semantic_loss": ("semantic-loss-regression", 0.010),
    "critical_error": ("critical-error-regression", 0.0), "calibration_error": ("calibration-regression", 0.010), "aurc": ("aurc-regression", 0.010),
}
RATIOS = {"real_time_factor": ("runtime-slower-than-policy", 1.05), "memory_mb": ("memory-regression", 1.05), "artifact_mb": ("artifact-size-regression", 1.0)}
IDENTITIES = {"manifest": "test-manifest-mismatch", "samples": "sample-count-mismatch", "groups": "group-count-mismatch", "hardware": "runtime-hardware-mismatch", "source_model": "source-model-mismatch", "source_revision": "source-revision-mismatch"}


def deployment_gate(pairs: DataFrame, *, minimum_replay: float = 0.999) -> DataFrame:
    """Reasons against deploying: columns b_<name> of the baseline against c_<name> of the candidate."""
    b, c = (lambda k: F.col(f"b_{k}")), (lambda k: F.col(f"c_{k}"))
    reasons = [F.when(~b(k).eqNullSafe(c(k)), F.lit(v)) for k, v in IDENTITIES.items()]
    reasons.append(F.when(c("calibration").isNull(), F.lit("missing-calibration-digest")).when(b("calibration").isNotNull() & (b("calibration") != c("calibration")), F.lit("calibration-digest-mismatch")))
    for k, (name, limit) in REGRESSIONS.items():
        worse = b(k) - c(k) if limit < 0 else c(k) - b(k)
        reasons.append(F.when(worse > abs(limit) + 1e-12, F.lit(name)))
    for k, (name, limit) in RATIOS.items():
        ratio = F.when(b(k) > 0, c(k) / F.nullif(b(k), F.lit(0.0))).when(c(k) <= 0, F.lit(1.0)).otherwise(F.lit(float("inf")))
        reasons.append(F.when(ratio > limit + 1e-12, F.lit(name)))
    reasons.append(F.when(c("replay_rate") < minimum_replay, F.lit("deterministic-replay-regression")))
    return pairs.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("accepted", F.size("reasons") == 0)
