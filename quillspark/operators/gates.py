"""Decisions whether a proposal, a policy or a further step is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def _reasons(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in pairs]))


#: Reasons that reject a proposal whatever its joint score.
HARD = ("uncalibrated-acoustic-verifier", "low-acoustic-compatibility", "low-alignment-coverage", "low-mora-compatibility", "excessive-surface-distance", "excessive-mora-distance")


def proposal_gate(proposals: DataFrame, candidates: DataFrame, *, acoustic: float = 0.72, coverage: float = 0.82, mora: float = 0.75, joint: float = 0.76, critical_extra: float = 0.10, surface_most: float = 0.55, mora_most: float = 0.50, provisional: float = 0.08) -> DataFrame:
    """Decision and reasons for each generated proposal against its group's nearest candidate.

    ``proposals``: (group_id, proposal_id, chars, morae, critical, acoustic, mora, coverage, calibrated); ``candidates``:
    (group_id, candidate_id, chars, morae, critical). Nearest: 0.55 surface + 0.45 mora distance, ties to the least id.
    Joint score: 0.50 acoustic + 0.28 mora + 0.22 coverage; a change of critical units raises what it must reach.
    """
    c = candidates.select("group_id", "candidate_id", F.col("chars").alias("c_chars"), F.col("morae").alias("c_morae"), F.col("critical").alias("c_critical"))
    far = X.symmetric_distance(F.col("chars"), F.col("c_chars"))
    far_mora = F.when((F.size("morae") == 0) | (F.size("c_morae") == 0), far).otherwise(X.array_distance(F.col("morae"), F.col("c_morae")))
    pairs = proposals.join(c, "group_id").withColumns({"surface_distance": far, "mora_distance": far_mora})
    near = pairs.groupBy("group_id", "proposal_id").agg(F.min(F.struct((0.55 * F.col("surface_distance") + 0.45 * F.col("mora_distance")).alias("d"), "candidate_id", "surface_distance", "mora_distance", "c_critical")).alias("n"))
    rows = proposals.join(near, ["group_id", "proposal_id"]).select("*", F.col("n.candidate_id").alias("nearest_id"), "n.surface_distance", "n.mora_distance", (~F.col("critical").eqNullSafe(F.col("n.c_critical"))).alias("critical_change")).drop("n")
    rows = rows.withColumn("joint", 0.50 * F.col("acoustic") + 0.28 * F.col("mora") + 0.22 * F.col("coverage"))
    rows = rows.withColumn("needed", F.least(F.lit(1.0), joint + F.when(F.col("critical_change"), critical_extra).otherwise(0.0)))
    reasons = _reasons([
        ("uncalibrated-acoustic-verifier", ~F.col("calibrated")), ("low-acoustic-compatibility", F.col("acoustic") < acoustic), ("low-alignment-coverage", F.col("coverage") < coverage), ("low-mora-compatibility", F.col("mora") < mora),
        ("low-joint-verification", F.col("joint") < F.col("needed")), ("excessive-surface-distance", F.col("surface_distance") > surface_most), ("excessive-mora-distance", F.col("mora_distance") > mora_most), ("meaning-critical-change", F.col("critical_change")),
    ])
    rows = rows.withColumn("reasons", reasons)
    hard = F.size(F.array_intersect("reasons", F.array(*[F.lit(h) for h in HARD]))) > 0
    decision = F.when(hard, "rejected").when(F.col("joint") >= F.col("needed"), "accepted-candidate").when(F.col("joint") >= F.greatest(F.lit(0.0), F.col("needed") - provisional), "provisional-candidate").otherwise("rejected")
    return rows.withColumn("decision", decision)


def merge_accepted(candidates: DataFrame, gated: DataFrame) -> DataFrame:
    """The group's candidates and the accepted proposals, as rows for pooling anew."""
    new = gated.where("decision = 'accepted-candidate'").select("group_id", F.col("proposal_id").alias("candidate_id"), F.col("chars").alias("text"), "acoustic", "mora", F.lit("guarded-proposal").alias("source"))
    return candidates.unionByName(new, allowMissingColumns=True)


def phone_policy(rows: DataFrame, *, language_weight: float = 0.0, minimum_gain: float = 0.0, regression: float = 0.0, edit_ratio: float = 0.35, agreement: bool = True) -> DataFrame:
    """(group_id, selected_id, selected_text, changed, reason) of (group_id, candidate_id, text, phones, phone, language, baseline).

    Among candidates whose phone score doesn't fall more than ``regression``, whose language score doesn't fall (if
    ``agreement``) and whose text is near, the highest gain over ``minimum_gain``; ties go to the least id, and the
    baseline stays unless something is strictly better.
    """
    base = rows.where("baseline").select("group_id", F.col("text").alias("b_text"), F.col("phones").alias("b_phones"), F.col("phone").alias("b_phone"), F.col("language").alias("b_language"), F.col("candidate_id").alias("b_id"))
    both = base.join(rows, "group_id")
    phone, language = F.col("phone") - F.col("b_phone"), F.col("language") - F.col("b_language")
    fine = (phone >= -regression - 1e-12) & (F.levenshtein("b_text", "text") / F.greatest(F.lit(1), F.length("b_text")) <= edit_ratio)
    if agreement:
        fine = fine & (language >= -1e-12)
    gain = phone + language_weight * language
    best = both.withColumn("gain", F.when(fine & ~F.col("baseline") & (gain > minimum_gain + 1e-12), gain))
    order = Window.partitionBy("group_id").orderBy(F.desc_nulls_last("gain"), F.desc("baseline"), "candidate_id")
    top = best.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    won = F.col("gain").isNotNull()
    text = F.when(won, F.col("text")).otherwise(F.col("b_text"))
    changed = text != F.col("b_text")
    reason = F.when(~changed, "retained-first-pass").when(F.col("phones") == F.col("b_phones"), "context-resolved-homophone").otherwise("phone-context-preference")
    return top.select("group_id", F.when(won, F.col("candidate_id")).otherwise(F.col("b_id")).alias("selected_id"), text.alias("selected_text"), changed.alias("changed"), reason.alias("reason"))


def fallback_guard(rows: DataFrame, *, regression: float = 0.0, floor: float | None = None, same_phone: bool = False, language_weight: float = 0.0) -> DataFrame:
    """Adds ``veto`` and ``reason`` to (b_*, p_*) pairs of a baseline and a decoder's proposal (p_text null: none).

    A veto needs a fall of the phone score beyond ``regression`` that the weighted language score doesn't make up, or, with
    ``same_phone``, other words with the same phones and a lower language score. Below ``floor`` the baseline's own phone score is
    no ground for a veto.
    """
    none = F.col("p_text").isNull()
    delta, language = F.col("p_phone") - F.col("b_phone"), F.col("p_language") - F.col("b_language")
    poor = F.lit(False) if floor is None else F.col("b_phone") < floor
    acoustic = ~poor & (delta < -regression - 1e-12)
    veto = acoustic & (delta + language_weight * language < -regression - 1e-12)
    words = lambda c: F.regexp_replace(c, r"(?U)[\p{P}\s]", "")
    spoken = F.lit(same_phone) & (F.col("b_phones") == F.col("p_phones")) & (words("b_text") != words("p_text")) & (language < -1e-12)
    reason = (
        F.when(none, "decoder-score-unavailable").when(veto, "decoder-phone-regression").when(spoken, "decoder-same-phone-language-regression").when(poor, "decoder-unresolved-low-baseline-fit")
        .when(acoustic, "decoder-unresolved-phone-language-conflict").otherwise("decoder-not-vetoed")
    )
    return rows.withColumns({"veto": none | F.coalesce(veto | spoken, F.lit(False)), "reason": reason})


def ask_teacher(n: Column, entropy: Column, margin: Column, disagreement: Column) -> Column:
    """Two candidates or more, and uncertain: entropy from 0.45, margin to 0.40 or disagreement from 0.18."""
    return (n >= 2) & ((entropy >= 0.45) | (margin <= 0.40) | (disagreement >= 0.18))


def route_matches(risk: Column, entropy: Column, disagreement: Column, criticality: Column, coverage: Column, *, minimum: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0), maximum_coverage: float = 1.0) -> Column:
    return (risk >= minimum[0]) & (entropy >= minimum[1]) & (disagreement >= minimum[2]) & (criticality >= minimum[3]) & (coverage <= maximum_coverage)


def default_policies(spark, counts: tuple[int, ...] = (1, 3, 5, 8, 16)) -> DataFrame:
    """A policy for each number of candidates, dearer with it, and one verified fallback without bounds."""
    n = sorted(set(counts))
    rows = [("k1-cheap", 1, 4_000.0, False)] + [(f"k{k}-rerank", k, 4_000.0 + 250 * k, False) for k in n if k > 1] + [(f"k{n[-1]}-verified-fallback", n[-1], float("inf"), True)]
    return spark.createDataFrame(rows, "policy_id string, candidate_count int, maximum_cost double, fallback boolean")


#: A table of policies is written by hand; one beyond this size is refused.
MAX_POLICIES = 1_000


def select_policy(policies: DataFrame, states: DataFrame) -> DataFrame:
    """(state_id, policy_id, eligible): the cheapest passing policy that a state admits, else the fallback.

    ``policies``: (policy_id, candidate_count, passed, fallback, mean_cost, upper, maximum_cost), at most ``MAX_POLICIES``
    rows, which become one ordered array that each state filters; ``states``: (state_id, available, budget). A state that
    neither a policy nor a fallback fits has no row.
    """
    if policies.limit(MAX_POLICIES + 1).count() > MAX_POLICIES:
        raise ValueError(f"over {MAX_POLICIES} policies")
    ordered = policies.agg(F.array_sort(F.collect_list(F.struct("mean_cost", "candidate_count", "upper", "policy_id", "passed", "fallback", "maximum_cost"))).alias("_all"))
    fits = lambda p: F.coalesce(p["passed"] & (F.col("available") >= p["candidate_count"]) & (p["maximum_cost"] <= F.col("budget")) & (p["mean_cost"] <= F.col("budget")), F.lit(False))
    first = lambda test: F.get(F.filter("_all", test), F.lit(0))["policy_id"]
    both = states.crossJoin(F.broadcast(ordered)).select("state_id", first(fits).alias("_fit"), first(lambda p: p["fallback"]).alias("_else"))
    return both.select("state_id", F.coalesce("_fit", "_else").alias("policy_id"), F.col("_fit").isNotNull().alias("eligible")).where("policy_id is not null")
