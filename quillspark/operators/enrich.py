"""Guards against degenerate hypotheses, second opinions, teachers, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as X


def degeneracy(rows: DataFrame, *, tokens: str = "tokens", ratio: str | None = None, maximum_ratio: float = 2.4, minimum_logprob: float = -1.0, maximum_repeat: float = 0.35, per_second: float = 12.0, floor: int = 8) -> DataFrame:
    """Adds ``degenerate`` and its reasons: compressed too well, repeating runs of tokens, unlikely, too many characters.

    ``ratio`` names a column with the compression ratio (see ``kernels.compression_ratio``); without it that rule rests.
    """
    characters = F.length(X.collapsed(F.col("text")))
    reasons = F.array_compact(
        F.array(
            F.when(F.col(ratio) > maximum_ratio, F.lit("compression-ratio")) if ratio else F.lit(None).cast("string"),
            F.when(X.repeated_fraction(F.col(tokens)) > maximum_repeat, F.lit("repeated-ngram")),
            F.when(F.col("avg_logprob") < minimum_logprob, F.lit("low-logprob")),
            F.when(F.col("duration_seconds").isNotNull() & (characters > floor + per_second * F.col("duration_seconds")), F.lit("character-budget")),
        )
    )
    return rows.withColumn("degenerate_reasons", reasons).withColumn("degenerate", F.size("degenerate_reasons") > 0)


def loop_guard(rows: DataFrame) -> DataFrame:
    """Without degenerate rows, unless all of a group are; ``rejected`` counts them."""
    w = S.whole("group_id")
    marked = rows.withColumns({"_bad": F.sum(F.col("degenerate").cast("int")).over(w), "_n": F.count(F.lit(1)).over(w)})
    return marked.where(~F.col("degenerate") | (F.col("_bad") == F.col("_n"))).withColumn("rejected", F.when(F.col("_bad") == F.col("_n"), F.lit(0)).otherwise(F.col("_bad"))).drop("_bad", "_n")


def min_max(x: str, over) -> Column:
    """To [0, 1] within a group; 1 where all are equal; null stays null."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(F.col(x).isNull(), F.lit(None).cast("double")).when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col(x) - low) / F.nullif(high - low, F.lit(0.0)))


def agreement(a: Column, b: Column) -> Column:
    """1 - character error rate, of folded texts; 0 if that is undefined."""
    rate = S.error_rate(F.levenshtein(a, b), F.length(a), F.length(b))
    return F.when(rate.isNull(), F.lit(0.0)).otherwise(1.0 - F.least(F.lit(1.0), rate))


def second_ear(rows: DataFrame, second: DataFrame, *, source: str = "second-ear", add: bool = False) -> DataFrame:
    """Adds a second recogniser's view: cross_model becomes the agreement with its text; without one rows stay.

    ``second``: (group_id, second_text). ``add`` also appends its text as a candidate where the group lacks it.
    """
    both = rows.join(second, "group_id", "left")
    own = F.when(F.col("second_text").isNotNull(), agreement(X.lenient(F.col("text")), X.lenient(F.col("second_text")))).otherwise(F.col("cross_model"))
    out = both.withColumn("cross_model", own)
    if not add:
        return out
    n = rows.groupBy("group_id").agg((F.count("*") + 1).cast("int").alias("n"))
    new = second.where("second_text is not null").join(rows.select("group_id", F.col("text").alias("second_text")), ["group_id", "second_text"], "left_anti").join(n, "group_id")
    extra = new.select("group_id", F.lit(f"{source}:0001").alias("candidate_id"), F.col("second_text").alias("text"), F.col("n").alias("rank"), F.lit(source).alias("source"), F.lit(True).alias("second_ear"), "second_text")
    merged = out.drop("second_ear").withColumn("second_ear", F.lit(False)).unionByName(extra, allowMissingColumns=True)
    return merged.withColumn("hypothesis_count", F.count(F.lit(1)).over(S.whole("group_id")).cast("int"))


def minmax_lexical(rows: DataFrame, value: str) -> DataFrame:
    return rows.withColumn("lexical", F.coalesce(min_max(value, S.whole("group_id")), "lexical"))


def guarded_scores(rows: DataFrame, *, acoustic_temperature: float = 0.2, ranker_temperature: float = 1.0, deadband: float = 0.08, strength: float = 6.0) -> DataFrame:
    """A ranker's score less what it claims beyond the acoustic evidence: strength * max(0, P(ranker) - P(acoustic) - deadband)."""
    w = S.whole("group_id")
    both = rows.withColumns({"_r": S.softmax_weight(F.col("ranker"), ranker_temperature, w), "_a": S.softmax_weight(F.coalesce("acoustic", F.lit(-8.0)), acoustic_temperature, w)})
    over = F.greatest(F.lit(0.0), F.col("_r") / F.sum("_r").over(w) - F.col("_a") / F.sum("_a").over(w) - deadband)
    return both.withColumn("guarded", F.col("ranker") - strength * over).drop("_r", "_a")


def linear_scores(rows: DataFrame, weights: dict[str, float], means: dict[str, float], scales: dict[str, float], bias: float = 0.0) -> DataFrame:
    """``ranker``: standardised features times weights."""
    total = F.lit(bias)
    for k, v in weights.items():
        total = total + v * ((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) - means.get(k, 0.0)) / scales.get(k, 1.0))
    return rows.withColumn("ranker", total)


def rerank(rows: DataFrame, score: str) -> DataFrame:
    """Adds ``position`` by falling score, ties to the least id, and the softmax of the scores."""
    w = S.whole("group_id")
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(score), "candidate_id"))).withColumn("_e", S.softmax_weight(F.col(score), 1.0, w))
    return ranked.withColumn("preference", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def log_opinion_pool(stages: DataFrame) -> DataFrame:
    """(group_id, candidate_id, p) of (group_id, candidate_id, stage, weight, p): softmax of weighted sums of ln p."""
    w = S.whole("group_id")
    total = stages.groupBy("group_id", "candidate_id").agg(F.sum(F.col("weight") * F.ln(F.greatest(F.col("p"), F.lit(S.LOG_EPSILON)))).alias("_s"))
    return total.withColumn("_e", S.softmax_weight(F.col("_s"), 1.0, w)).select("group_id", "candidate_id", (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def capped_shares(rows: DataFrame, *, maximum: float = 0.6) -> DataFrame:
    """Shares of ``weight`` within a group, none above ``maximum`` while others can take the excess.

    A group's shares are an array that a fold caps and rescales. Each round caps one more share or changes nothing, so there
    are as many rounds as shares.
    """
    xs = F.array_sort(F.collect_list(F.struct("teacher", "weight")))

    def once(a: Column, _: Column) -> Column:
        excess = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x["p"] - maximum))
        room = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x["p"] < maximum, x["p"]).otherwise(F.lit(0.0)))
        moved = F.transform(a, lambda x: F.struct(x["teacher"].alias("teacher"), F.when(x["p"] >= maximum, F.lit(maximum)).otherwise(x["p"] + excess * x["p"] / F.nullif(room, F.lit(0.0))).alias("p")))
        return F.when((excess > 1e-12) & (room > 0), moved).otherwise(a)

    total = F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["weight"])
    shares = F.transform("xs", lambda x: F.struct(x["teacher"].alias("teacher"), (x["weight"] / total).alias("p")))
    out = rows.groupBy("group_id").agg(xs.alias("xs")).select("group_id", F.aggregate(F.sequence(F.lit(1), F.size("xs")), shares, once).alias("out"))
    return out.select("group_id", F.explode("out").alias("x")).select("group_id", "x.teacher", F.col("x.p").alias("share"))


def frozen_consensus(rows: DataFrame, *, primary: str, others: tuple[str, ...], fallback: str) -> DataFrame:
    """(group_id, text, engine): the primary's text where all engines agree on the lenient key, else the fallback's.

    Exactly one row for each engine is expected; a missing or doubled one raises.
    """
    engines = (primary, *others, fallback)
    key = X.lenient(F.col("text"))
    per = rows.withColumn("k", key).groupBy("group_id").agg(F.count_distinct("k").alias("keys"), F.count("*").alias("n"), F.count_distinct("engine").alias("m"), *[F.max(F.when(F.col("engine") == e, F.col("text"))).alias(f"t_{e}") for e in engines])
    fine = (F.col("n") == len(set(engines))) & (F.col("m") == len(set(engines)))
    agree = F.col("keys") == 1
    text = F.when(~fine, F.raise_error(F.concat(F.lit("engines missing or doubled in "), F.col("group_id").cast("string")))).when(agree, F.col(f"t_{primary}")).otherwise(F.col(f"t_{fallback}"))
    return per.select("group_id", text.alias("text"), F.when(agree, F.lit(primary)).otherwise(F.lit(fallback)).alias("engine"), agree.alias("agree"))


def transition_pmi(arcs: DataFrame, posterior: DataFrame, *, temperature: float = 1.0, epsilon: float = 1e-9) -> DataFrame:
    """(doc, left_arc, right_arc, value): tanh of the pointwise mutual information of arcs of neighbouring spans.

    ``arcs``: (doc, span, arc, candidate_id), a row for each candidate that takes the arc; ``posterior``: (doc, candidate_id, p).
    Joint mass is summed over the candidates that take both, found by an equi-join on (doc, candidate, span).
    """
    weighed = arcs.join(posterior, ["doc", "candidate_id"])
    mass = weighed.groupBy("doc", "span", "arc").agg(F.sum("p").alias("mass"))
    a, b = weighed.select("doc", "span", "arc", "candidate_id", "p"), weighed.select("doc", (F.col("span") - 1).alias("span"), F.col("arc").alias("next"), "candidate_id")
    joint = a.join(b, ["doc", "span", "candidate_id"]).groupBy("doc", "span", "arc", "next").agg(F.sum("p").alias("joint"))
    left, right = mass.select("doc", "span", "arc", F.col("mass").alias("lm")), mass.select("doc", (F.col("span") - 1).alias("span"), F.col("arc").alias("next"), F.col("mass").alias("rm"))
    pairs = left.join(right, ["doc", "span"]).join(joint, ["doc", "span", "arc", "next"], "left")
    pmi = F.ln((F.coalesce("joint", F.lit(0.0)) + epsilon) / (F.col("lm") * F.col("rm") + epsilon))
    return pairs.select("doc", "span", F.col("arc").alias("left_arc"), F.col("next").alias("right_arc"), F.tanh(pmi / temperature).alias("value"))
