"""Vectorised Python steps for what Spark's functions lack: Unicode folding, zlib, HMAC, kana, numerals, diffs.

Each is an Arrow-batched UDF over a column; plain functions underneath are usable and tested by themselves.
"""

from __future__ import annotations

import difflib
import hashlib
import hmac
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType

from quillspark.functions.kana import katakana, morae

# Numeral characters, phrases that keep theirs, and the languages that write them.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "兩": 2, "两": 2}
UNITS = {"千": 1000, "百": 100, "十": 10}
KEPT_PHRASES = ("一番", "一緒", "一部", "四国", "九州", "十分", "一石二鳥", "二人三脚", "一体", "一旦", "一気", "七夕", "三味線", "二重", "十字架", "一杯")
NUMERAL_LANGUAGES = ("ja", "zh", "yue")


def nfkc(x: str) -> str:
    return unicodedata.normalize("NFKC", x)


def surface_key(x: str) -> str:
    return unicodedata.normalize("NFC", x).strip()


def lenient_key(x: str) -> str:
    return "".join(c for c in nfkc(x) if not c.isspace() and unicodedata.category(c)[0] not in "PS")


def folded(x: str) -> str:
    """Compatibility folding, without white space: the characters that error rates count."""
    return "".join(nfkc(x).split())


def compression_ratio(x: str) -> float:
    raw = x.encode()
    return len(raw) / len(zlib.compress(raw)) if raw else 1.0


def pseudonym(x: str, secret: bytes) -> str:
    if len(secret) < 16:
        raise ValueError("the secret has at least 16 bytes")
    return "speaker-" + hmac.new(secret, x.encode(), hashlib.sha256).hexdigest()[:24]


_D, _Z, _N = "".join(DIGITS), "〇零", "".join(c for c, v in DIGITS.items() if v)
#: A run of numerals that is read as one, and its decimals.
_NUMERAL = re.compile(f"[{_D}千百十万萬億]{{1,12}}(?:点[{_D}]{{1,10}})?")
#: Thousands, hundreds and tens, each with a digit or alone, then ones; noughts may stand before a digit.
_PLACES = re.compile("".join(f"(?:(?:[{_Z}]*([{_N}]))?({unit}))?" for unit in UNITS) + f"[{_Z}]*([{_N}])?")
_PARTS = re.compile(f"(?:([{_D}千百十]*)(億))?(?:([{_D}千百十]*)([万萬]))?([{_D}千百十]*)")


def _digits(x: str) -> str:
    return "".join(str(DIGITS[c]) for c in x)


def _below_ten_thousand(x: str) -> str | None:
    """One segment as a number: by places if it has 千, 百 or 十, else digit by digit; nothing if it is ambiguous."""
    if not any(u in x for u in UNITS):
        return str(int(_digits(x))) if x else None
    m = _PLACES.fullmatch(x)
    if m is None:
        return None
    given = m.groups()
    total = sum(UNITS[unit] * (DIGITS[digit] if digit else 1) for digit, unit in zip(given[0:6:2], given[1:6:2], strict=True) if unit)
    return str(total + (DIGITS[given[6]] if given[6] else 0))


def _written(x: str) -> str:
    """A run of numerals in Arabic digits, 万 and 億 kept; as it is if it is a single numeral or ambiguous."""
    whole, point, decimals = x.partition("点")
    if len(x) == 1:
        return x
    if point:
        plain = all(c in DIGITS for c in whole)
        left = _digits(whole) if plain else _below_ten_thousand(whole) if any(u in whole for u in UNITS) else None
        return x if left is None else f"{left}.{_digits(decimals)}"
    m = _PARTS.fullmatch(x)
    if m is None:
        return x
    first, oku, second, man, rest = m.groups()
    if not oku and not man:
        return (_below_ten_thousand(rest) or x) if any(u in rest for u in UNITS) else _digits(rest)
    out = []
    for segment, unit in ((first, oku), (second, man)):
        if unit:
            out += [_below_ten_thousand(segment) if segment else "1", unit]
    if rest:
        out.append(_below_ten_thousand(rest))
    return x if None in out else "".join(out)


def numerals(x: str, exclude: tuple[str, ...] = (), force: dict[str, str] | None = None, language: str = "ja") -> str:
    """Kanji numerals to Arabic digits: 三千二百 as 3200, 四万人 as 4万人, 二点四 as 2.4, 一九四五年 as 1945年.

    Single numerals stay, and so does what touches one of KEPT_PHRASES or of ``exclude``. ``force`` is replaced first,
    literally. Languages other than NUMERAL_LANGUAGES are left as they are.
    """
    if language not in NUMERAL_LANGUAGES:
        return x
    for k, v in (force or {}).items():
        x = x.replace(k, v) if k else x
    held = [m.span(1) for phrase in {*KEPT_PHRASES, *exclude} - {""} for m in re.finditer(f"(?=({re.escape(phrase)}))", x)]
    return _NUMERAL.sub(lambda m: m.group() if any(a < m.end() and m.start() < b for a, b in held) else _written(m.group()), x)


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    return difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()


def longest_common_substring(a: str, b: str) -> int:
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else 0
            best = max(best, row[j])
    return best


def critical_units(x: str) -> list[str]:
    """Typed spans in order: amounts, dates, numbers and negations, then entities that no typed span holds."""
    from quillspark.functions import text as X

    x, found = nfkc(x), []
    for kind, pattern in (("currency", X.CURRENCY), ("date-time", X.DATE_TIME), ("number", X.NUMBER), ("negation", X.NEGATION)):
        found += [(*m.span(), f"{kind}:{m.group()}") for m in re.finditer(pattern, x)]
    typed = [(a, b) for a, b, _ in found]
    found += [(*m.span(), f"entity:{m.group()}") for m in re.finditer(X.ENTITY, x) if not any(a <= m.start() and m.end() <= b for a, b in typed)]
    return [u for _, _, u in sorted(found)]


def join_fragments(parts: list[str], most: int = 160) -> str:
    """Fragments joined without the longest text (2 to ``most`` characters) that ends one and begins the next.

    A closing mark that both sides have at the seam stays once; Latin letters or digits at the seam get a space.
    """
    out = ""
    for part in (p.strip() for p in parts if p and p.strip()):
        if out:
            shared = next((n for n in range(min(most, len(out), len(part)), 1, -1) if out.endswith(part[:n])), 0)
            part = part[shared:]
            if most > 0 and part[:1] and part[0] == out[-1] and part[0] in "、。！？!?":
                part = part[1:]
            edge = lambda c: c.isascii() and (c.isalnum() or c in "_+-/#@.%")
            if part and edge(out[-1]) and edge(part[0]):
                out += " "
        out += part
    return out


def _text(f, kind: DataType = StringType()):  # noqa: B008
    """A null-keeping UDF of one text column."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


nfkc_column = _text(nfkc)
surface_key_column = _text(surface_key)
lenient_key_column = _text(lenient_key)
folded_column = _text(folded)
katakana_column = _text(katakana)
morae_column = _text(morae, ArrayType(StringType()))
compression_ratio_column = _text(compression_ratio, DoubleType())
critical_units_column = _text(critical_units, ArrayType(StringType()))
numerals_column = _text(numerals)
join_fragments_column = _text(lambda v: join_fragments(list(v)))


def pseudonym_column(secret: bytes):
    return _text(lambda v: pseudonym(v, secret))


@F.pandas_udf(DoubleType())
def span_agreement_column(candidate: pd.Series, span: pd.Series) -> pd.Series:
    """Longest common substring over the span's length, on lenient keys; 1 if contained, 0 for an empty span."""
    keys = ((lenient_key(a or ""), lenient_key(b or "")) for a, b in zip(candidate, span, strict=True))
    return pd.Series([0.0 if not b else 1.0 if b in a else longest_common_substring(a, b) / len(b) for a, b in keys])


def register(spark) -> None:
    """Make the kernels callable from SQL."""
    for name, f in {"nfkc": nfkc_column, "surface_key": surface_key_column, "lenient_key": lenient_key_column, "mora_split": morae_column, "itn_ja": numerals_column, "zlib_ratio": compression_ratio_column, "critical_units": critical_units_column}.items():
        spark.udf.register(name, f)
