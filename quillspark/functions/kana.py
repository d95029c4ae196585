"""Kana, morae and phones."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex

# The phones of each kana mora.
_INVENTORY = """
ア:a イ:i ウ:u エ:e オ:o
カ:k-a キ:k-i ク:k-u ケ:k-e コ:k-o   ガ:g-a ギ:g-i グ:g-u ゲ:g-e ゴ:g-o
サ:s-a シ:sh-i ス:s-u セ:s-e ソ:s-o   ザ:z-a ジ:j-i ズ:z-u ゼ:z-e ゾ:z-o
タ:t-a チ:ch-i ツ:ts-u テ:t-e ト:t-o   ダ:d-a ヂ:j-i ヅ:z-u デ:d-e ド:d-o
ナ:n-a ニ:n-i ヌ:n-u ネ:n-e ノ:n-o
ハ:h-a ヒ:h-i フ:f-u ヘ:h-e ホ:h-o   バ:b-a ビ:b-i ブ:b-u ベ:b-e ボ:b-o   パ:p-a ピ:p-i プ:p-u ペ:p-e ポ:p-o
マ:m-a ミ:m-i ム:m-u メ:m-e モ:m-o
ヤ:y-a ユ:y-u ヨ:y-o   ラ:r-a リ:r-i ル:r-u レ:r-e ロ:r-o
ワ:w-a ヰ:i ヱ:e ヲ:o ヴ:v-u ン:N ッ:cl
キャ:ky-a キュ:ky-u キョ:ky-o キェ:ky-e   ギャ:gy-a ギュ:gy-u ギョ:gy-o ギェ:gy-e
シャ:sh-a シュ:sh-u ショ:sh-o シェ:sh-e   ジャ:j-a ジュ:j-u ジョ:j-o ジェ:j-e
チャ:ch-a チュ:ch-u チョ:ch-o チェ:ch-e   ヂャ:j-a ヂュ:j-u ヂョ:j-o ヂェ:j-e
ニャ:ny-a ニュ:ny-u ニョ:ny-o ニェ:ny-e   ヒャ:hy-a ヒュ:hy-u ヒョ:hy-o ヒェ:hy-e
ビャ:by-a ビュ:by-u ビョ:by-o ビェ:by-e   ピャ:py-a ピュ:py-u ピョ:py-o ピェ:py-e
ミャ:my-a ミュ:my-u ミョ:my-o ミェ:my-e   リャ:ry-a リュ:ry-u リョ:ry-o リェ:ry-e
ファ:f-a フィ:f-i フェ:f-e フォ:f-o フャ:fy-a フュ:fy-u フョ:fy-o   ヴァ:v-a ヴィ:v-i ヴェ:v-e ヴォ:v-o
ツァ:ts-a ツィ:ts-i ツェ:ts-e ツォ:ts-o   ティ:t-i テュ:ty-u トゥ:t-u   ディ:d-i デュ:dy-u ドゥ:d-u
スィ:s-i ズィ:z-i   ウィ:w-i ウェ:w-e ウォ:w-o   イェ:y-e
クァ:kw-a クィ:kw-i クェ:kw-e クォ:kw-o クヮ:kw-a   グァ:gw-a グィ:gw-i グェ:gw-e グォ:gw-o グヮ:gw-a
"""
# Kana that may join the one before; marks that break morae; vowels (capitals: devoiced); pauses.
SMALL_KANA = "ァィゥェォャュョヮヵヶ"
PUNCTUATION = frozenset(" \t\r\n、。,.!?！？・「」『』（）()［］[]【】…‥:：;；\"'“”‘’")
VOWELS, DEVOICED, PAUSES = ("a", "i", "u", "e", "o"), ("I", "U"), ("sil", "pau")

PHONES: dict[str, tuple[str, ...]] = {kana: tuple(phones.split("-")) for kana, phones in (entry.split(":") for entry in _INVENTORY.split())}
COMBINATIONS = frozenset(kana for kana in PHONES if len(kana) == 2)


def _spellings() -> dict[tuple[str, ...], tuple[str, ...]]:
    found: dict[tuple[str, ...], list[str]] = {}
    for kana in sorted(PHONES):
        found.setdefault(PHONES[kana], []).append(kana)
    return {phones: tuple(kana) for phones, kana in found.items()}


KANA = _spellings()
#: A gap, a long mark, a mora of the inventory; nothing else has phones.
_SCAN = regex.compile(rf"(?P<gap>[\s\p{{P}}]+)|(?P<long>ー)|(?P<mora>{'|'.join(sorted(PHONES, key=len, reverse=True))})")
_TO_KATAKANA = {code: code + 0x60 for code in range(0x3041, 0x3097)}


@dataclass(frozen=True)
class Unit:
    kana: tuple[str, ...]
    phones: tuple[str, ...]
    kind: str
    devoiced: bool = False
    maybe_long: bool = False


def katakana(x: str) -> str:
    return unicodedata.normalize("NFKC", x).translate(_TO_KATAKANA)


def is_katakana(c: str) -> bool:
    return "゠" <= c <= "ヿ"


def morae(x: str) -> list[str]:
    """Kana as morae; a small kana joins the one right before it if the two are a known pair."""
    out: list[str] = []
    joins = False
    for c in katakana(x):
        if joins and c in SMALL_KANA and out[-1] + c in COMBINATIONS:
            out[-1] += c
            continue
        joins = is_katakana(c) and c not in PUNCTUATION
        if joins:
            out.append(c)
    return out


def kind_of(kana: str) -> str:
    return {"ン": "moraic-nasal", "ッ": "geminate", "ー": "long-vowel"}.get(kana, "regular")


def kana_to_phones(text: str) -> list[Unit]:
    """Strict: only kana; a long mark repeats the vowel before it, and anything unknown raises."""
    out: list[Unit] = []
    text, at, vowel = katakana(text), 0, None
    while at < len(text):
        hit = _SCAN.match(text, at)
        if hit is None:
            raise ValueError(f"no phones for {text[at]!r}; give a reading")
        at = hit.end()
        if hit["gap"]:
            vowel = None
            continue
        if hit["long"] and vowel is None:
            raise ValueError("a long-vowel mark without a vowel before it")
        phones = (vowel,) if hit["long"] else PHONES[hit["mora"]]
        out.append(Unit((hit.group(),), phones, kind_of(hit.group())))
        vowel = phones[-1] if phones[-1] in VOWELS else None
    return out


def phones_to_units(phones: list[str]) -> list[Unit]:
    """Phones grouped to morae without loss; devoiced vowels are vowels, an equal vowel again may be length."""
    single = {**dict.fromkeys(PAUSES, "pause"), "N": "moraic-nasal", "cl": "geminate"}
    out, last, rest = [], None, list(phones)
    while rest:
        onset = rest[0] not in single and rest[0] not in VOWELS + DEVOICED
        raw = tuple(rest[: 2 if onset and rest[1:2] and rest[1] in VOWELS + DEVOICED else 1])
        rest = rest[len(raw) :]
        voiced = tuple(p.lower() if p in DEVOICED else p for p in raw)
        kana = KANA.get(voiced, ())
        vowel = voiced[-1] if voiced[-1] in VOWELS else None
        out.append(Unit(kana, raw, single.get(raw[0]) or ("regular" if kana else "unresolved"), raw != voiced, len(raw) == 1 and vowel is not None and vowel == last))
        last = vowel
    return out


def timed_morae(rows: list[tuple[str, float, float, float | None]]) -> list[tuple[str, float, float, float | None]]:
    """(character, start, end, confidence) rows to morae: a small kana joins the one right before it, with the lower
    confidence; anything that isn't kana breaks the neighbourhood. Confidences are held to 0..1, times that are missing
    come from the other part."""
    out: list[list] = []
    joins = False
    for raw, start, end, conf in rows:
        conf = None if conf is None else min(1.0, max(0.0, conf))
        for c in katakana(raw):
            if joins and c in SMALL_KANA and out[-1][0] + c in COMBINATIONS:
                kana, begun, ended, held = out[-1]
                both = [x for x in (held, conf) if x is not None]
                out[-1] = [kana + c, start if begun is None else begun, ended if end is None else end, min(both, default=None)]
                continue
            joins = is_katakana(c) and c not in PUNCTUATION
            if joins:
                out.append([c, start, end, conf])
    return [tuple(x) for x in out]


def reading(text: str) -> str | None:
    """The text in katakana if it is nothing but kana and marks."""
    x = katakana(text.strip())
    return x if x and all(c in PUNCTUATION or is_katakana(c) for c in x) else None
