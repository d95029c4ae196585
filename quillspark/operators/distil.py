"""Several teachers' judgments to one preference, and losses that compare preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import canonical as J
from quillspark.functions import scores as S
from quillspark.operators.enrich import capped_shares


def teacher_consensus(judgments: DataFrame, *, temperature: float = 1.0, share: float = 0.60, floor: float = 0.10, most: float = 0.42, minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """((group_id, candidate_id, preference), (group_id, disagreement, active, usable, reasons)).

    ``judgments``: (group_id, teacher, candidate_id, score, kind, reliability, abstained), every teacher on every candidate
    of its group. Probabilities are normalised, other scores go through a softmax. A teacher weighs reliability times one less its
    entropy (at least ``floor``), no more than ``share`` of all.
    """
    w = Window.partitionBy("group_id", "teacher")
    mass = F.when(F.col("kind") == "probability", F.greatest(F.col("score"), F.lit(0.0))).otherwise(S.softmax_weight(F.col("score"), temperature, w))
    on = judgments.where(~F.col("abstained")).withColumn("_m", mass).withColumn("p", F.col("_m") / F.sum("_m").over(w)).withColumn("entropy", S.normalised_entropy(F.col("p"), w))
    weight = on.groupBy("group_id", "teacher").agg((F.max("reliability") * F.greatest(F.lit(floor), 1.0 - F.max("entropy"))).alias("weight"))
    shares = capped_shares(weight, maximum=share)
    mixed = on.join(shares, ["group_id", "teacher"]).groupBy("group_id", "candidate_id").agg(F.sum(F.col("share") * F.col("p")).alias("_s"))
    g = Window.partitionBy("group_id")
    preference = mixed.select("group_id", "candidate_id", (F.col("_s") / F.sum("_s").over(g)).alias("preference"))

    mean = on.withColumn("_mix", F.avg("p").over(Window.partitionBy("group_id", "candidate_id")))
    kl = F.when(F.col("p") > 0, F.col("p") * F.ln((F.col("p") + S.LOG_EPSILON) / (F.col("_mix") + S.LOG_EPSILON))).otherwise(F.lit(0.0))
    spread = mean.groupBy("group_id").agg(F.sum(kl).alias("_kl"), F.count_distinct("teacher").alias("active"), F.count_distinct("candidate_id").alias("_n"))
    groups = judgments.select("group_id").distinct().join(spread, "group_id", "left").withColumn("active", F.coalesce("active", F.lit(0)))
    js = F.when(F.col("active") <= 1, F.lit(0.0)).otherwise(S.clip(F.col("_kl") / F.col("active") / F.ln(F.greatest("_n", F.lit(2)).cast("double")), 0.0, 1.0))
    groups = groups.withColumn("disagreement", js)
    reasons = F.array_compact(F.array(F.when(F.col("active") < minimum, F.lit("insufficient-active-teachers")), F.when(F.col("disagreement") > most, F.lit("teacher-disagreement")), F.when(F.col("active") == 0, F.lit("all-teachers-abstained"))))
    return preference, groups.select("group_id", "disagreement", "active", reasons.alias("reasons")).withColumn("usable", F.size("reasons") == 0)


def preference_losses(preference: DataFrame, floor: float = 1e-8) -> DataFrame:
    """-ln of the preference, at least ``floor``: losses to train a ranker on."""
    return preference.withColumn("loss", -F.ln(F.greatest(F.lit(floor), F.col("preference"))))


def decoupled_top_k(rows: DataFrame, *, k: int, temperature: float = 1.0) -> DataFrame:
    """(group_id, mass_kl, inner_kl, loss) of (group_id, candidate_id, teacher, student) scores.

    Divergence of the mass that teacher and student put on the teacher's top k (against all the rest), and of their
    distributions within it, weighed by the teacher's mass.
    """
    w = S.whole("group_id")
    rows = rows.withColumns({"_t": S.softmax_weight(F.col("teacher"), temperature, w), "_s": S.softmax_weight(F.col("student"), temperature, w)})
    rows = rows.withColumns({"t": F.col("_t") / F.sum("_t").over(w), "s": F.col("_s") / F.sum("_s").over(w), "_r": F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("teacher"), "candidate_id"))})
    e = S.LOG_EPSILON
    rows = rows.withColumn("_on", F.col("_r") <= k)
    top = rows.withColumns({"top_t": F.sum(F.when(F.col("_on"), F.col("t")).otherwise(0.0)).over(w), "top_s": F.sum(F.when(F.col("_on"), F.col("s")).otherwise(0.0)).over(w)})
    inner = F.when(F.col("_on"), F.col("t") / F.col("top_t") * F.ln((F.col("t") / F.col("top_t") + e) / (F.col("s") / F.col("top_s") + e))).otherwise(0.0)
    out = top.groupBy("group_id").agg(F.max("top_t").alias("top_t"), F.max("top_s").alias("top_s"), F.sum(inner).alias("inner_kl"))
    part = lambda a, b: F.when(a > 0, a * F.ln((a + e) / (b + e))).otherwise(0.0)
    mass = part(F.col("top_t"), F.col("top_s")) + part(F.greatest(F.lit(0.0), 1 - F.col("top_t")), F.greatest(F.lit(0.0), 1 - F.col("top_s")))
    return out.select("group_id", mass.alias("mass_kl"), "inner_kl", (mass + F.col("top_t") * F.col("inner_kl")).alias("loss"))


def pairwise_alignment(rows: DataFrame, *, beta: float = 1.0, margin: float = 0.0, absolute: float = 0.0) -> DataFrame:
    """Adds ``loss``: softplus of what the chosen text's mean log probability lacks over the rejected one's, each against a
    reference where there is one; ``absolute`` adds the chosen text's own shortfall."""
    softplus = lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))
    mean = lambda a, n: F.col(a) / F.greatest(F.col(n), F.lit(1))
    chosen = mean("chosen_logprob", "chosen_length") - F.coalesce(mean("reference_chosen_logprob", "chosen_length"), F.lit(0.0))
    rejected = mean("rejected_logprob", "rejected_length") - F.coalesce(mean("reference_rejected_logprob", "rejected_length"), F.lit(0.0))
    return rows.withColumn("loss", softplus(-(beta * (chosen - rejected) - margin)) + absolute * softplus(-beta * chosen))


def candidate_digests(candidates: DataFrame) -> DataFrame:
    """(group_id, digest) of (group_id, candidate_id, text, token_ids, source): one digest a set, whatever its rows' order.

    A set of fewer than two candidates, and one that repeats an id, raises.
    """
    one = J.record({"candidateId": J.quoted(F.col("candidate_id")), "text": J.quoted(F.col("text")), "source": J.quoted(F.col("source")), "tokenIds": J.array(F.coalesce(F.col("token_ids").cast("array<string>"), F.array().cast("array<string>")))})
    sets = candidates.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", one.alias("json")))).alias("all"))
    ids = F.transform("all", lambda x: x["candidate_id"])
    problem = F.when(F.size("all") < 2, F.lit("fewer than two candidates in ")).when(F.size(F.array_distinct(ids)) < F.size("all"), F.lit("repeated candidate ids in "))
    whole = J.digest(J.array(F.transform("all", lambda x: x["json"])))
    return sets.select("group_id", F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.col("group_id").cast("string"))).cast("string")).otherwise(whole).alias("digest"))
