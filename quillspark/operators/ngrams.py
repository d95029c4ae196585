"""Count-based n-gram models and suffix caches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"


def _padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BOS), order - 1), tokens, F.array(F.lit(EOS)))


def positions(docs: DataFrame, order: int, *, tokens: str = "tokens") -> DataFrame:
    """(id, pos, target, history): each token and the end, with the ``order`` - 1 tokens before. Empty texts give none."""
    padded = docs.where(F.size(tokens) > 0).select("id", _padded(F.col(tokens), order).alias("w"))
    at = padded.select("id", "w", F.explode(F.sequence(F.lit(order), F.size("w"))).alias("i"))
    return at.select("id", (F.col("i") - order).alias("pos"), F.element_at("w", F.col("i")).alias("target"), F.slice("w", F.col("i") - (order - 1), order - 1).alias("history") if order > 1 else F.array().cast("array<string>").alias("history"))


def _suffix(n: int, order: int) -> Column:
    """The last n - 1 tokens of the history, as one string."""
    return F.array_join(F.slice("history", order - n + 1, n - 1), "\u0001") if n > 1 else F.lit("")


def count(docs: DataFrame, order: int, *, tokens: str = "tokens") -> DataFrame:
    """(n, context, target, c) for n = 1 .. order, added up map-side first."""
    at = positions(docs, order, tokens=tokens)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _suffix(n, order).alias("context")) for n in range(1, order + 1)]))
    return at.select("target", each.alias("x")).groupBy("x.n", "x.context", "target").agg(F.count("*").alias("c"))


def context_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n", "context").agg(F.sum("c").alias("total"))


def score(docs: DataFrame, counts: DataFrame, order: int, *, alpha: float = 0.1, step: float = 0.12, tokens: str = "tokens") -> DataFrame:
    """(id, tokens, unknown, total, average): the highest order whose context was seen, minus ``step`` a step down.

    add-alpha over the vocabulary and one unknown word; the end counts as a token in the average. Contexts and grams
    meet the model in equi-joins, two for each order above the first, so the model may be any size; the first order has
    one context, whose total is a number, and one join by word.
    """
    single = counts.where("n = 1").select("target", F.col("c").alias("c1"))
    whole = single.agg(F.count("*").alias("v"), F.coalesce(F.sum("c1"), F.lit(0)).alias("t")).first()
    v = whole.v + 1
    at = positions(docs, order, tokens=tokens).join(single, "target", "left").withColumns({"known": F.col("c1"), "t1": F.lit(whole.t)})
    totals = context_totals(counts.where("n > 1"))
    for n in range(order, 1, -1):
        at = at.withColumn(f"x{n}", _suffix(n, order))
        at = at.join(totals.where(F.col("n") == n).select(F.col("context").alias(f"x{n}"), F.col("total").alias(f"t{n}")), f"x{n}", "left")
        at = at.join(counts.where(F.col("n") == n).select(F.col("context").alias(f"x{n}"), "target", F.col("c").alias(f"c{n}")), [f"x{n}", "target"], "left")
    p = None
    for n in range(order, 0, -1):
        value = F.ln((F.coalesce(f"c{n}", F.lit(0)) + alpha) / (F.coalesce(f"t{n}", F.lit(0)) + alpha * v)) - step * (order - n)
        seen = F.lit(True) if n == 1 else F.coalesce(f"t{n}", F.lit(0)) > 0
        p = F.when(seen, value) if p is None else p.when(seen, value)
    out = at.withColumn("lp", p).groupBy("id").agg((F.count("*") - 1).alias("tokens"), F.count_if(F.col("known").isNull()).alias("unknown"), F.sum("lp").alias("total"))
    return out.withColumn("average", F.col("total") / (F.col("tokens") + 1))


def suffix_lookup(queries: DataFrame, cache: DataFrame, *, maximum: int = 3, penalty: float = 0.35, missing: float = -12.0) -> DataFrame:
    """(id, pos, log_probability, matched_order, exact, backoff_steps) of (id, pos, history, target).

    The longest suffix of the history that the cache (context, target, log_probability) holds with the target; each
    token less costs ``penalty``. Suffixes are exploded and met in one equi-join.
    """
    most = F.least(F.lit(maximum), F.size("history"))
    tried = queries.withColumn("_most", most).withColumn("_order", F.explode(F.sequence(F.lit(0), F.col("_most"))))
    tried = tried.withColumn("context", F.array_join(F.slice("history", F.size("history") - F.col("_order") + 1, F.greatest(F.col("_order"), F.lit(0))), "\u0001"))
    hit = tried.join(cache.select("context", "target", "log_probability", F.size(F.filter(F.split("context", "\u0001"), lambda x: x != "")).alias("_len")), ["context", "target"], "left").where(F.col("_len").isNull() | (F.col("_len") == F.col("_order")))
    best = hit.groupBy("id", "pos", "_most").agg(F.max(F.when(F.col("log_probability").isNotNull(), F.struct("_order", "log_probability"))).alias("b"))
    steps = F.col("_most") - F.col("b._order")
    return best.select("id", "pos", F.when(F.col("b").isNotNull(), F.col("b.log_probability") - penalty * steps).otherwise(F.lit(missing)).alias("log_probability"), F.coalesce("b._order", F.lit(0)).alias("matched_order"), F.coalesce(steps == 0, F.lit(False)).alias("exact"), F.coalesce(steps, F.col("_most") + 1).alias("backoff_steps"))


def surprisal_threshold(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the nearest-rank quantile, the ceil(q n)-th smallest value (percentile() would interpolate)."""
    return rows.where(F.col(value).isNotNull()).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("threshold"), F.count("*").alias("n"))
