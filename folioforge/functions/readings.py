"""Readings for speech: rules in their order, inside Catalyst.

A pattern is only tried where the fixed sign that it holds is in the text at
all; words without variants are replaced as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Numbers with a unit, in the order in which they apply.
NUMBERS = (
    ("([0-9]{4})年", "$1ねん"), ("([0-9]+)億円", "$1おくえん"), ("([0-9]+)万円", "$1まんえん"), ("([0-9]+)千円", "$1せんえん"), ("([0-9]+)円", "$1えん"), ("([0-9]+)%", "$1パーセント"),
    ("1ヶ月", "いっかげつ"), ("([0-9]+)ヶ月", "$1かげつ"), ("2日間", "ふつかかん"), ("([0-9]+)日間", "$1にちかん"), ("7大", "ななだい"),
)
#: Abbreviations, as words of their own; those of ANY_CASE in any case.
ABBREVIATIONS = (
    ("AI", "えーあい"), ("SNS", "えすえぬえす"), ("WEB", "うぇぶ"), ("LINE", "らいん"), ("GPTs?", "じーぴーてぃーず"), ("Kindle", "きんどる"), ("YouTube", "ゆーちゅーぶ"), ("X", "えっくす"), ("LP", "えるぴー"),
    ("VSL", "ぶいえすえる"), ("API", "えーぴーあい"), ("PDF", "ぴーでぃーえふ"), ("URL", "ゆーあーるえる"), ("QR", "きゅーあーる"), ("CTA", "しーてぃーえー"), ("ROI", "あーるおーあい"), ("KPI", "けーぴーあい"),
)
ANY_CASE = ("WEB", "Kindle", "YouTube")
#: Idioms and business words.
IDIOMS = (("虎視眈々", "こしたんたん"), ("門外不出", "もんがいふしゅつ"), ("下剋上", "げこくじょう"), ("一石二鳥", "いっせきにちょう"), ("一網打尽", "いちもうだじん"), ("起死回生", "きしかいせい"))
BUSINESS = (
    ("先行者利益", "せんこうしゃりえき"), ("累計売上", "るいけいうりあげ"), ("緊急開催", "きんきゅうかいさい"), ("期間限定", "きかんげんてい"), ("先着限定", "せんちゃくげんてい"),
    ("無料公開", "むりょうこうかい"), ("独自開発", "どくじかいはつ"), ("完全網羅", "かんぜんもうら"), ("徹底解説", "てっていかいせつ"), ("実績公開", "じっせきこうかい"),
)
_WORD = "[A-Za-z0-9_]"


def _as_word(pattern: str) -> str:
    """The pattern where no Latin letter, digit or underscore stands beside it; kana and kanji are no such letters."""
    return ("(?i)" if pattern in ANY_CASE else "") + f"(?<!{_WORD}){pattern}(?!{_WORD})"


def applied(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after all rules (pattern, reading), one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def _guarded(text: Column, pattern: str, reading: str, sign: str, any_case: bool = False) -> Column:
    """The text after a rule, which is tried where ``sign`` is in the text."""
    has = lambda t: t.rlike(f"(?i){sign}") if any_case else F.contains(t, F.lit(sign))
    return let(text, lambda t: F.when(has(t), F.regexp_replace(t, pattern, reading)).otherwise(t))


def _replaced(text: Column, words: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, w: F.replace(t, F.lit(w[0]), F.lit(w[1])), words, text)


def read_aloud(text: Column, numbers: bool = True, abbreviations: bool = True, custom: list[tuple[str, str]] | None = None) -> Column:
    """The text with numbers, abbreviations, idioms, business words and ``custom`` rules (pattern, reading) read out, in this order."""
    if numbers:
        for p, reading in NUMBERS:
            text = _guarded(text, p, reading, p.rsplit(")", 1)[-1])
    if abbreviations:
        for p, reading in ABBREVIATIONS:
            text = _guarded(text, _as_word(p), reading, p.removesuffix("s?"), p in ANY_CASE)
    return applied(_replaced(text, IDIOMS + BUSINESS), custom or [])
