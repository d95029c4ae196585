"""Text columns: keys, token arrays and similarities from Spark's built-in functions.

Unicode compatibility folding is not among those functions; ``quillspark.functions.kernels`` adds it as a vectorised
step, once, before these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what counts as a number, date or time, amount, negation and named entity, and annotation brackets.
NUMBER = r"(?:[0-9][0-9,.:/-]*|[〇一二三四五六七八九十百千万億兆]+)"
DATE_TIME = r"(?:[0-9]{1,4}[/-][0-9]{1,2}(?:[/-][0-9]{1,2})?|[0-9]{1,2}:[0-9]{2}|[0-9]+(?:年|月|日|時|分|秒))"
CURRENCY = r"(?:[¥￥$€£][ \t\n\x0B\f\r]*[0-9][0-9,.]*|[0-9][0-9,.]*(?:円|ドル|ユーロ|ポンド))"
NEGATION = r"(?:ない|なく|なかった|ません|ませんでした|じゃない|ではない|ぬ|ず)"
ENTITY = r"(?:[0-9][0-9,.:/%-]*|[A-Za-z][A-Za-z0-9+._/#-]*|[゠-ヿー]{2,}|[㐀-鿿]{2,})"
PUNCTUATION = r"[、。！？!?：:；;]"
FILLER, DISFLUENCY, UNCERTAIN, INAUDIBLE, MASK = r"\(F[ \t\n\x0B\f\r]+([^()]*)\)", r"\(D2?[ \t\n\x0B\f\r]+([^()]*)\)", r"\(\?[ \t\n\x0B\f\r]+([^()]*)\)", r"\(\?\)", r"\[[A-Za-z][A-Za-z0-9_-]*\]"


def collapsed(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def lenient(x: Column) -> Column:
    """Of a folded text: without white space, punctuation and symbols."""
    return F.regexp_replace(x, r"(?U)[\p{P}\p{S}\s]", "")


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def matches(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def annotation_counts(x: Column) -> dict[str, Column]:
    """Fillers, disfluencies, uncertain or inaudible spans and masked spans."""
    n = lambda p: F.regexp_count(x, F.lit(p))
    return {"fillers": n(FILLER), "disfluencies": n(DISFLUENCY), "uncertain": n(UNCERTAIN) + n(INAUDIBLE), "masked": n(MASK)}


def spoken_surface(x: Column) -> Column:
    """Annotations replaced by what was said in them; runs of white space become one space."""
    for pattern in (FILLER, DISFLUENCY, UNCERTAIN):
        x = F.regexp_replace(x, pattern, "$1")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, INAUDIBLE, ""), r"[ \t\n\x0B\f\r]+", " "))


def bigrams(x: Column) -> Column:
    """Distinct runs of two characters; a single character stands for itself."""
    n = F.length(x)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    return F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs))


def dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) over distinct bigrams; 0 if either is empty."""
    x, y = bigrams(a), bigrams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def phrase_similarity(query: Column, phrase: Column, *, phonetic: bool = False) -> Column:
    """1 if equal; a contained phrase 0.98 (phonetic 0.96); a contained query 0.72 + 0.22 of its share, at most 0.94;
    else the better of Dice and edit similarity, times 0.72 (phonetic 0.82)."""
    n, m = F.length(query), F.length(phrase)
    fuzzy = F.greatest(dice(query, phrase), edit_similarity(query, phrase)) * (0.82 if phonetic else 0.72)
    return (
        F.when((n == 0) | (m == 0), F.lit(0.0)).when(query == phrase, F.lit(1.0)).when(F.contains(query, phrase), F.lit(0.96 if phonetic else 0.98))
        .when((n >= 2) & F.contains(phrase, query), F.least(F.lit(0.94), 0.72 + 0.22 * n / F.greatest(m, F.lit(1)))).otherwise(fuzzy)
    )


def jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    total = F.size(F.array_union(x, y))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / total)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits over the longer length; 0 if either text is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def symmetric_distance(a: Column, b: Column) -> Column:
    """Edits over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def array_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays: each distinct element of the two becomes a character of its own, and the
    built-in distance compares the texts. Up to 1,000,000 distinct elements; nulls equal each other."""

    def letter(x: Column, distinct: Column) -> Column:
        code = F.coalesce(F.array_position(distinct, x), F.lit(0)) + 256
        return F.lpad(F.hex(code + F.when(code >= 0xD800, F.lit(0x2800)).otherwise(F.lit(0))), 8, "0")  # past surrogates and private use

    def distance(s: Column) -> Column:
        written = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda v: letter(v, s["distinct"])), "")), "UTF-32")
        return F.levenshtein(written(s["a"]), written(s["b"]))

    # The distinct elements are bound once, in an array of one, so that they aren't found anew for each element.
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("distinct"))), distance), F.lit(0))


def array_distance(a: Column, b: Column) -> Column:
    """Array edits over the longer size; 0 for two empty arrays."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((longest == 0) | (a == b), F.lit(0.0)).otherwise(array_edit_distance(a, b) / longest)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Elements that two arrays have in common, each as often as in the array that has it less often."""
    times = lambda arr, v: F.size(F.filter(arr, lambda y: y == v))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))


def multiset_f1(a: Column, b: Column) -> Column:
    """1 if both are empty, 0 if one is."""
    n, m = F.size(a), F.size(b)
    shared = multiset_overlap(a, b)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | (shared == 0), F.lit(0.0)).otherwise(2.0 * shared / (n + m))


def repeated_fraction(tokens: Column, order: int = 4) -> Column:
    """1 - distinct / all runs of ``order`` tokens; 0 for fewer than 2 * order tokens."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - order + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, order), "\u0001"))
    return F.when(n < 2 * order, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(runs)) / F.size(runs))
