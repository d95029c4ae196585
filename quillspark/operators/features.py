"""Features of candidates for learnt rankers, and the directional loss between two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as X

# How much each part of the directional loss weighs.
DIRECTIONAL = {"character": 0.44, "mora": 0.16, "number": 0.10, "date_time": 0.06, "negation": 0.09, "critical_entity": 0.08, "disfluency": 0.04, "unsupported_insertion": 0.03}


def candidate_features(rows: DataFrame, *, context: str | None = None) -> DataFrame:
    """Fourteen features as columns f_*: streams (unknown: 0), likelihoods, rank, paths, sources, length, critical units, overlap."""
    n = F.coalesce("hypothesis_count", F.greatest(F.lit(1), F.coalesce("rank", F.lit(1))))
    rank = F.coalesce("rank", n)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made = {f"f_{c}": zero(c) for c in ("acoustic", "mora", "lexical", "preservation", "cross_model", "avg_logprob", "sequence_score")}
    made |= {
        "f_reciprocal_rank": 1.0 / F.greatest(F.lit(1), rank), "f_relative_rank": F.when(n <= 1, F.lit(1.0)).otherwise((n - rank) / F.greatest(F.lit(1), n - 1)),
        "f_log_path_count": F.log1p(F.greatest(F.lit(1), F.coalesce("path_count", F.lit(1)))), "f_source_diversity": F.coalesce("source_count", F.lit(1)).cast("double"), "f_log_text_length": F.log1p(F.length("text")),
        "f_critical_units": F.size(X.matches(F.col("text"), X.ENTITY)).cast("double"), "f_context_overlap": X.jaccard(F.col("text"), F.col(context)) if context else F.lit(0.0),
    }
    return rows.withColumns(made)


def surface_features(rows: DataFrame) -> DataFrame:
    """Seventeen features as columns g_* for constrained rankers, with the share of streams that are missing."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    n = F.coalesce("hypothesis_count", F.greatest(F.lit(1), F.coalesce("rank", F.lit(1))))
    flag = lambda c: c.cast("double")
    streams = ("acoustic", "mora", "lexical", "preservation", "cross_model")
    missing = sum((F.col(c).isNull().cast("int") for c in streams[1:]), F.col(streams[0]).isNull().cast("int")) / len(streams)
    text = F.col("text")
    return rows.withColumns({
        "g_aggregate": F.coalesce("cumulative_logprob", "avg_logprob", F.lit(0.0)), "g_best_path": zero("avg_logprob"), "g_mass_bonus": zero("path_mass_bonus") if "path_mass_bonus" in rows.columns else F.lit(0.0), "g_beam": zero("beam_confidence"),
        "g_rank": F.when(n <= 1, F.lit(1.0)).otherwise((n - F.coalesce("rank", n)) / F.greatest(F.lit(1), n - 1)), "g_mora": zero("mora"), "g_lexical": zero("lexical"), "g_preservation": zero("preservation"), "g_cross_model": zero("cross_model"),
        "g_sources": F.coalesce("source_count", F.lit(1)).cast("double"), "g_paths": F.coalesce("path_count", F.lit(1)).cast("double"), "g_length": F.length("text").cast("double"),
        "g_number": flag(text.rlike(r"\p{Nd}")), "g_negation": flag(text.rlike("[無未非不]|ない|ません|ず|ぬ")), "g_entity": flag(text.rlike("[ァ-ヶ]")), "g_teacher": zero("teacher"), "g_missing": missing,
    })


def _rate(truth: Column, said: Column) -> Column:
    """Array edits over the truth's size, at most 1; 1 for something said where there is nothing."""
    return F.when(F.size(truth) == 0, F.when(F.size(said) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.least(F.lit(1.0), X.array_edit_distance(truth, said) / F.size(truth)))


def directional_loss(said: Column, truth: Column, *, said_morae: Column | None = None, truth_morae: Column | None = None) -> dict[str, Column]:
    """Eight parts and their weighted sum ``loss``: what saying ``said`` costs if ``truth`` was meant. Texts are folded.

    What is said of a kind that the truth has nothing of counts in full.
    """
    a, b = X.collapsed(said), X.collapsed(truth)
    character = F.when(F.length(b) == 0, F.when(F.length(a) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.least(F.lit(1.0), F.levenshtein(b, a) / F.length(b)))
    of = lambda p: _rate(X.matches(truth, p), X.matches(said, p))
    fillers = "えーっと|えっとー|えーと|ええと|えっと|あのー|あのう|うーん|えー|あの|その|まあ|んー"
    parts = {
        "character": character, "mora": character if said_morae is None or truth_morae is None else F.when(said_morae.isNull() | truth_morae.isNull(), character).otherwise(_rate(truth_morae, said_morae)),
        "number": of(X.NUMBER), "date_time": of(X.DATE_TIME), "negation": of(X.NEGATION), "critical_entity": of(X.ENTITY), "disfluency": of(fillers),
        "unsupported_insertion": F.when(F.length(a) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0), F.length(a) - F.length(b)) / F.length(a)),
    }
    loss = F.lit(0.0)
    for k, w in DIRECTIONAL.items():
        loss = loss + w / sum(DIRECTIONAL.values()) * parts[k]
    return parts | {"loss": loss}


def transcript_measures(reference: Column, observed: Column, normalised: Column | None = None) -> dict[str, Column]:
    """Error rates of a folded transcript at once: characters, lenient, numbers, dates, amounts, negations, entities, marks."""
    from quillspark.operators.evaluate import cer, pattern_error_rate

    a, b = X.collapsed(reference), X.collapsed(observed)
    out = {
        "cer": cer(a, b), "lenient_cer": cer(X.lenient(reference), X.lenient(observed)), "number": pattern_error_rate(a, b, X.NUMBER), "date_time": pattern_error_rate(a, b, X.DATE_TIME), "currency": pattern_error_rate(a, b, X.CURRENCY),
        "negation": pattern_error_rate(a, b, X.NEGATION), "entity": pattern_error_rate(a, b, X.ENTITY), "punctuation_f1": X.multiset_f1(X.matches(reference, X.PUNCTUATION), X.matches(observed, X.PUNCTUATION)),
    }
    if normalised is not None:
        out |= {"normalised_cer": cer(a, X.collapsed(normalised)), "changed": S.error_rate(F.levenshtein(b, X.collapsed(normalised)), F.length(b), F.length(X.collapsed(normalised)))}
    return out
