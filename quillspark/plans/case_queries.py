"""Kernels on tables of cases, each with the value that it must give written down beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import japanese as J
from quillspark.functions import kana as A
from quillspark.functions import kernels as K

NUMERALS = [
    ("二〇二四万円", "2024万円"), ("一二万", "12万"), ("二〇億三〇万円", "20億30万円"), ("一二百円", "一二百円"), ("一百零五元", "105元"), ("三千二百", "3200"), ("一百五十", "150"), ("四十九", "49"), ("四万人弱", "4万人弱"),
    ("一億円", "1億円"), ("三千万円", "3000万円"), ("三万五千円", "3万5000円"), ("四萬人", "4萬人"), ("兩百", "200"), ("两千", "2000"), ("二点四", "2.4"), ("八零二点一", "802.1"), ("三十点五", "30.5"), ("一九四五年", "1945年"),
    ("零一二三", "0123"), ("一つください", "一つください"), ("十本", "十本"), ("一番好きです", "一番好きです"), ("四国と九州", "四国と九州"), ("十分に二十分", "十分に二十分"), ("二十歳", "20歳"), ("零十", "零十"), ("点五", "点五"), ("", ""),
]
PHONES = [
    ("きゃ ティ ファール", "ky-a t-i f-a a r-u"), ("しんぶん", "sh-i N b-u N"), ("がっこう", "g-a cl k-o u"), ("えーおー", "e e o o"), ("えいおう", "e i o u"), ("ヂャヂュヂョヂェ", "j-a j-u j-o j-e"), ("スィズィイェ", "s-i z-i y-e"),
    ("ギェビェピェ", "gy-e by-e py-e"), ("フャフュフョ", "fy-a fy-u fy-o"), ("テュデュ", "ty-u dy-u"), ("ヰヱヲヴ", "i e o v-u"), ("クヮグヮ", "kw-a gw-a"), ("ー", None), ("キャ。ー", None), ("ンー", None), ("キャャ", None), ("カィ", None), ("日本", None),
]
HEARD = [
    ("sil k I t a a pau", "pause:-:- regular:キ:d regular:タ:- regular:ア:l pause:-:-"), ("j i cl N q", "regular:ジ/ヂ:- geminate:ッ:- moraic-nasal:ン:- unresolved:-:-"), ("o o", "regular:オ/ヲ:- regular:オ/ヲ:l"),
    ("f y u", "unresolved:-:- regular:ユ:-"), ("A k E", "unresolved:-:- unresolved:-:- unresolved:-:-"), ("sp", "unresolved:-:-"), ("s U", "regular:ス:d"),
]
MORAE = [("きゃく", "キャ ク"), ("ティファール", "ティ ファ ー ル"), ("スーパー", "ス ー パ ー"), ("ギェヂェビェピェ", "ギェ ヂェ ビェ ピェ"), ("き、ゃ", "キ ャ"), ("きx ゃ", "キ ャ"), ("ﾃﾞｰﾀ・ベース", "デ ー タ ベ ー ス"), ("漢字", ""), ("カヶ", "カ ヶ")]
NORMALISED = [
    ("ＡＩ  、便利!!!!!", "AI、便利！！"), ("A , b .", "A , b ."), ("( a )", "( a)"), ("「 はい 」", "「はい」"), ("a\n 。b", "a。b"), ("今日 は !!!!\n\n\n\nはい。。。。", "今日 は！！\n\nはい。。"), ("really?!", "really?!"), ("豈?", "豈？"),
    ("x \t y", "x y"), ("a\r\nb\rc", "a\nb\nc"), ("  ", ""),
]
FRAGMENTS = [("今日は学校へ|学校へ行きます。", "今日は学校へ行きます。"), ("OpenAI|API", "OpenAI API"), ("はい。|。次", "はい。次"), ("終わり|り方", "終わりり方"), ("| a |b", "a b"), ("同じ|同じ", "同じ")]
UNITS = [
    ("3時に500円払わない", "number:3 date-time:3時 number:500 currency:500円 entity:円払 negation:ない"), ("2024/01/02の会議", "date-time:2024/01/02 number:2024/01/02 entity:会議"), ("トヨタのPython3", "entity:トヨタ entity:Python3 number:3"), ("", ""),
]
READINGS = [("かな、カナ", "カナ、カナ"), ("漢", None), ("  ", None), ("ﾃﾞｰﾀ", "データ")]
FILLERS = [("えーっと、あのう今日は", "え あの"), ("そのまあうーん", "その まあ うーん"), ("んー", "んー"), ("なし", "")]
TOKENS = [("character", "a 日", "a|日"), ("whitespace", "a  日本", "a|日本"), ("mora", "きゃく", "キャ|ク"), ("mora", "漢字", "surface:漢|surface:字"), ("subword", "日本語 Data-3", "日本|本語|data-3")]


def _table(spark, rows, kind):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {kind}")


def _shown(f):
    """A kernel as a column; where it raises, nothing."""

    def safe(x):
        try:
            return f(x)
        except ValueError:
            return None

    return K._text(safe)


def itn_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in NUMERALS], "text string").select("id", K.numerals_column("text").alias("value"))


def phone_cases(spark, sf):
    shown = _shown(lambda x: " ".join("-".join(u.phones) for u in A.kana_to_phones(x)))
    return _table(spark, [(a,) for a, _ in PHONES], "text string").select("id", shown("text").alias("value"))


def heard_cases(spark, sf):
    shown = _shown(lambda x: " ".join(f"{u.kind}:{'/'.join(u.kana) or '-'}:{'d' if u.devoiced else 'l' if u.maybe_long else '-'}" for u in A.phones_to_units(x.split())))
    return _table(spark, [(a,) for a, _ in HEARD], "text string").select("id", shown("text").alias("value"))


def mora_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in MORAE], "text string").select("id", F.array_join(K.morae_column("text"), " ").alias("value"))


def normalise_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in NORMALISED], "text string").select("id", J.normalise_column("text").alias("value"))


def fragment_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in FRAGMENTS], "text string").select("id", K.join_fragments_column(F.split("text", "\\|")).alias("value"))


def critical_unit_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in UNITS], "text string").select("id", F.array_join(K.critical_units_column("text"), " ").alias("value"))


def reading_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in READINGS], "text string").select("id", J.reading_column("text").alias("value"))


def filler_cases(spark, sf):
    return _table(spark, [(a,) for a, _ in FILLERS], "text string").select("id", F.array_join(J.fillers_column("text"), " ").alias("value"))


def token_cases(spark, sf):
    parts = [_table(spark, [(m, a) for m, a, _ in TOKENS], "mode string, text string").where(F.col("mode") == m).select("id", F.array_join(J.tokens_column(m)("text"), "|").alias("value")) for m in ("character", "whitespace", "mora", "subword")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _values(rows) -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(r[-1])})" for i, r in enumerate(rows)) + ") v(id, value)"


_CASES = {"itn_cases": NUMERALS, "phone_cases": PHONES, "heard_cases": HEARD, "mora_cases": MORAE, "normalise_cases": NORMALISED, "fragment_cases": FRAGMENTS, "critical_unit_cases": UNITS, "reading_cases": READINGS, "filler_cases": FILLERS, "token_cases": TOKENS}

QUERIES = {f.__name__: f for f in (itn_cases, phone_cases, heard_cases, mora_cases, normalise_cases, fragment_cases, critical_unit_cases, reading_cases, filler_cases, token_cases)}
SQL = {name: _values(rows) for name, rows in _CASES.items()}
