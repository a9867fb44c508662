"""Readings of ideographs learnt from the table itself, and spellings that don't tell romanisations apart."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.kana import kana_romaji
from linkspark.operators.readings import learn_readings

# Hepburn spellings and the plainer ones they are folded to, in the order in which they are replaced.
FOLDS = [
    ("tch", "ch"), ("shi", "si"), ("sh", "sy"), ("chi", "ti"), ("ch", "ty"), ("tsu", "tu"), ("ji", "zi"), ("j", "zy"),
    ("ck", "k"), ("c", "k"), ("fu", "hu"), ("dzu", "zu"), ("du", "zu"), ("di", "zi"), ("mb", "nb"), ("mp", "np"), ("mm", "nm"),
]
_FOLD = [(re.compile(a), b) for a, b in FOLDS]
_LONG = re.compile(r"(.)\1+")


def plain_spelling(romaji: str) -> str:
    """Lower-case letters in which spellings of one reading agree: no accents, long vowels, doubled letters."""
    text = unicodedata.normalize("NFKD", romaji.lower())
    text = re.sub(r"[^a-z]", "", text)
    for a, b in _FOLD:
        text = a.sub(b, text)
    text = text.replace("ou", "o")
    return _LONG.sub(r"\1", text)


def reading_lexicon(rows: DataFrame, name: str = "name", reading: str = "furigana") -> dict[str, str]:
    """The commonest reading of each ideograph, in plain spelling; at most as many entries as there are ideographs."""
    found = learn_readings(rows, name, reading).where("i = 1").collect()
    return {r["ideograph"]: kana_romaji(r["reading"]) for r in found}


def spell(text: str, lexicon: dict[str, str]) -> str | None:
    """Plain spelling of kana, ideographs and Latin letters; None if an ideograph has no reading."""
    out = []
    for c in text:
        if "一" <= c <= "鿿":
            if c not in lexicon:
                return None
            out.append(lexicon[c])
        else:
            out.append(c)
    return plain_spelling(kana_romaji("".join(out)))


def column_or_null(df: DataFrame, name: str) -> Column:
    """The column as text, or null where the table lacks it."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
