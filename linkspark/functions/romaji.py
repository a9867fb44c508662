"""Romanisation of kana (and of ideographs by a lexicon) and its spelling variants, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions.kana import SYLLABLES, kana_romaji

# Long vowels and their short spellings, in the order in which they are replaced.
LONG_VOWELS = [("ou", "o"), ("oo", "o"), ("uu", "u"), ("ii", "i"), ("ei", "e"), ("ee", "e"), ("aa", "a")]


def to_romaji(c: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Lower-case Hepburn of the kana in the text, without blanks between words; null gives ''.

    lexicon: spellings of ideographs or words in kana, the longest of which are tried first; an ideograph without a
    reading stays. Single ideographs are looked up like syllables, however many the lexicon has.
    """
    katakana = "".join(chr(x) for x in range(0x30A1, 0x30F7))
    hiragana = "".join(chr(x - 0x60) for x in range(0x30A1, 0x30F7))
    text = F.translate(F.coalesce(c, F.lit("")), katakana, hiragana)
    words = lexicon or {}
    for word in sorted((w for w in words if len(w) > 1), key=lambda w: (-len(w), w)):
        text = F.replace(text, F.lit(word), F.translate(F.lit(lexicon[word]), katakana, hiragana))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((SYLLABLES | {w: kana_romaji(r) for w, r in words.items() if len(w) == 1}).items())])
    pairs = "|".join(k for k in SYLLABLES if len(k) == 2)
    units = F.regexp_extract_all(text, F.lit(f"((?s:{pairs}|.))"), 1)
    joined = F.array_join(F.transform(units, lambda u: F.coalesce(F.try_element_at(table, u), u)), "")
    doubled = F.replace(F.regexp_replace(joined, "っ([b-df-hj-mp-tv-z])", "$1$1"), F.lit("っ"), F.lit(""))
    long = doubled
    for _ in range(3):
        long = F.regexp_replace(long, "([aiueo])ー", "$1$1")
    return F.lower(F.replace(long, F.lit("ー"), F.lit("")))


def romaji_variants(base: Column) -> Column:
    """Spellings of a romanised text: itself, all long vowels short, one kind short at a time, a last long vowel short."""
    full = base
    single = []
    for long, short in LONG_VOWELS:
        full = F.replace(full, F.lit(long), F.lit(short))
        single.append(F.replace(base, F.lit(long), F.lit(short)))
    last = F.regexp_replace(base, "([aiueo])\\1+$", "$1")
    return F.when(F.length(base) > 0, F.array_distinct(F.array(base, full, *single, last))).otherwise(F.array().cast("array<string>"))
