"""What kinds of meaning a span's alternatives differ in, and how much that matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each kind of span and its weight, in the order in which kinds are named; and characters of particles.
PATTERNS = {
    "number-or-quantity": "[0-9０-９〇一二三四五六七八九十百千万億兆]",
    "date-or-time": "(?:[0-9]{1,4}[/-][0-9]{1,2}(?:[/-][0-9]{1,2})?|[0-9]{1,2}:[0-9]{2}|[年月日時分秒])",
    "currency": "[¥￥$€£]|円|ドル|ユーロ|ポンド",
    "percentage": "%|％|パーセント",
    "negation-meaning-flip": "(?:ない|なく|なかった|ません|ませんでした|じゃない|ではない|ぬ|ず)",
    "modality-or-intent": "(?:かもしれない|はず|べき|予定|つもり|と思う|と思います)",
    "disfluency-or-repair": "(?:えー+|えっと|ええと|あの+|その+|まあ+|うーん|んー)",
    "particle-or-functional": "[はがをにへとでのもやかねよぞさなってらまりしば]",
    "latin-acronym-or-term": "[A-Za-z][A-Za-z0-9+._/#-]*",
    "entity-or-domain-term": "[㐀-鿿]{2,}|[゠-ヿー]{3,}",
    "special-mora": "[ンッーんっﾝｯｰ]",
}
WEIGHTS = {
    "negation-meaning-flip": 1.00, "number-or-quantity": 1.00, "date-or-time": 1.00, "currency": 1.00, "percentage": 0.98, "entity-or-domain-term": 0.93, "latin-acronym-or-term": 0.91,
    "modality-or-intent": 0.90, "special-mora": 0.82, "particle-or-functional": 0.76, "disfluency-or-repair": 0.72, "phonetic-or-punctuation": 0.45,
}
PARTICLE_LENGTH = 4


def kinds(pivot: Column, alternatives: Column) -> Column:
    """Kinds that any of the texts has; a particle counts in texts of at most four characters. Without any: phonetic."""
    texts = F.concat(F.array(pivot), alternatives)
    together = F.array_join(texts, "")

    def has(kind: str, pattern: str) -> Column:
        if kind == "particle-or-functional":
            return F.exists(texts, lambda t: (F.length(t) <= PARTICLE_LENGTH) & t.rlike(pattern))
        return together.rlike(pattern)

    found = F.array_compact(F.array(*[F.when(has(k, p), F.lit(k)) for k, p in PATTERNS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("phonetic-or-punctuation")))


def criticality(found: Column) -> Column:
    """The highest weight of the kinds; an unknown kind weighs as a phonetic one."""
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.array_max(F.transform(found, lambda k: F.coalesce(F.try_element_at(table, k), F.lit(WEIGHTS["phonetic-or-punctuation"]))))
