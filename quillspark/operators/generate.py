"""Corrupted variants of a text for training rankers, as an array of rule hits inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S

# Fixed values: (kind, severity, replacements); each replaces the first place where its left side occurs.
RULES = (
    ("negation-flip", 1.0, (("ません", "ます"), ("ない", "ある"), ("なかった", "あった"), ("できない", "できる"), ("行かない", "行く"))),
    ("particle", 0.45, (("を", "に"), ("に", "で"), ("は", "が"), ("へ", "に"), ("が", "を"))),
    ("geminate-delete", 0.60, (("っ", ""),)),
    ("long-vowel-delete", 0.60, (("ー", ""),)),
    ("moraic-nasal-delete", 0.60, (("ん", ""),)),
    ("contracted-sound-expand", 0.60, (("きゃ", "きや"), ("きゅ", "きゆ"), ("きょ", "きよ"), ("しゃ", "しや"), ("しゅ", "しゆ"), ("しょ", "しよ"))),
    ("number", 1.0, ("+1", "-1", "+10")),
    ("filler-delete", 0.55, ("えー", "えっと", "あの", "その", "まあ", "うーん")),
    ("phonetic-neighbour", 0.35, (("か", "が"), ("た", "だ"), ("さ", "ざ"), ("は", "ば"), ("し", "ち"), ("つ", "す"))),
)
MAXIMUM = 12


def _variant(text: Column, start: Column, n: Column | int, new: Column, kind: str, severity: float) -> Column:
    """The text with ``n`` characters at ``start`` (from 0) replaced; null where ``start`` is negative."""
    end = start + n
    changed = F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))
    return F.when(start >= 0, F.struct(F.lit(-severity).alias("order"), F.lit(kind).alias("kind"), changed.alias("text"), start.alias("start"), end.alias("end")))


def _variants(text: Column) -> list[Column]:
    out = []
    for kind, severity, rules in RULES:
        if kind == "number":
            digit = F.regexp_extract(text, "[0-9]", 0)
            at = F.when(digit == "", F.lit(-1)).otherwise(F.instr(text, digit) - 1)
            out += [_variant(text, at, 1, F.pmod(F.expr("0") + digit.cast("int") + int(d), F.lit(10)).cast("string"), kind, severity) for d in rules]
        elif kind == "filler-delete":
            filler = F.regexp_extract(text, "|".join(rules), 0)
            out.append(_variant(text, F.when(filler == "", F.lit(-1)).otherwise(F.instr(text, filler) - 1), F.length(filler), F.lit(""), kind, severity))
        else:
            out += [_variant(text, F.instr(text, old) - 1, len(old), F.lit(new), kind, severity) for old, new in rules]
    return out


def corruptions(text: Column, *, maximum: int = MAXIMUM) -> Column:
    """Array of (kind, text, severity, start, end): up to ``maximum`` distinct variants by falling severity, kind, text.

    A variant that two rules give belongs to the first of them. Digits are ASCII digits.
    """
    found = F.filter(F.array(*_variants(text)), lambda v: v.isNotNull() & (v["text"] != text))
    first = F.filter(found, lambda v, i: ~F.exists(F.slice(found, F.lit(1), i), lambda earlier: earlier["text"] == v["text"]))
    return F.transform(F.slice(F.array_sort(first), 1, maximum), lambda v: F.struct(v["kind"].alias("kind"), v["text"].alias("text"), (-v["order"]).alias("severity"), v["start"].alias("start"), v["end"].alias("end")))


def hard_negatives(rows: DataFrame, *, id_col: str = "id", text_col: str = "text", maximum: int = MAXIMUM) -> DataFrame:
    """(id, kind, text, severity, start, end) of each row's variants; null and empty texts have none."""
    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("original")).where(F.length("original") > 0)
    return given.select("id", F.explode(corruptions(F.col("original"), maximum=maximum)).alias("v")).select("id", "v.*")


def ranker_examples(rows: DataFrame, *, id_col: str = "id", text_col: str = "text", maximum: int = 8) -> DataFrame:
    """Candidates for training a ranker: each text as ``reference`` and its variants as ``negative-002``, -003, ...

    Evidence is made up to fall with a variant's severity and place (fixed values below), so that no stream alone tells
    the reference; (group_id, candidate_id, text, kind, severity, rank, hypothesis_count, acoustic, mora, preservation,
    avg_logprob, source). Losses come from ``features.directional_loss`` against the reference.
    """
    given = rows.select(F.col(id_col).alias("group_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    own = F.struct(F.lit("none").alias("kind"), F.col("text"), F.lit(0.0).alias("severity"))
    made = F.transform(corruptions(F.col("text"), maximum=maximum), lambda v: F.struct(v["kind"].alias("kind"), v["text"].alias("text"), v["severity"].alias("severity")))
    each = given.select("group_id", F.posexplode(F.concat(F.array(own), made)).alias("i", "v")).select("group_id", "i", "v.*", (F.col("i") + 1).alias("rank"))
    first, s = F.col("i") == 0, F.col("severity")
    lost = F.when(F.col("kind") == "filler-delete", 0.55).otherwise(0.20)
    return each.select(
        "group_id", F.when(first, F.lit("reference")).otherwise(F.format_string("negative-%03d", "rank")).alias("candidate_id"), "text", "kind", "severity", "rank",
        F.when(first, F.lit(maximum + 1)).otherwise(F.count("*").over(S.whole("group_id"))).cast("int").alias("hypothesis_count"),
        F.when(first, F.lit(0.92)).otherwise(F.greatest(F.lit(0.05), 0.85 - 0.35 * s - F.col("rank") * 0.01)).alias("acoustic"),
        F.when(first, F.lit(0.94)).otherwise(F.greatest(F.lit(0.05), 0.86 - 0.40 * s)).alias("mora"),
        F.when(first, F.lit(0.95)).otherwise(F.greatest(F.lit(0.05), 0.90 - lost * s)).alias("preservation"),
        F.when(first, F.lit(-0.08)).otherwise(-0.12 - 0.28 * s - F.col("rank") * 0.01).alias("avg_logprob"),
        F.when(first, F.lit("synthetic-reference")).otherwise(F.lit("synthetic-corruption")).alias("source"),
    )
