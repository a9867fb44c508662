"""Six-character phonetic keys of names in Latin letters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions.romaji import to_romaji

# The digit of every letter; 0 stands for letters without one.
CLASSES = {"0": "aeiouhwy", "1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "lr", "5": "mn"}
KEY_LENGTH = 6


def phonetic_key(c: Column) -> Column:
    """First letter in capitals, then the digits of the others without runs and zeros, filled up with 0; '' without letters."""
    letters = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z]", ""))
    source = "".join(CLASSES.values())
    digits = "".join(d * len(letters_) for d, letters_ in CLASSES.items())
    runs = F.regexp_replace(F.translate(letters, source, digits), "(\\d)\\1+", "$1")
    rest = F.replace(F.substring(runs, F.lit(2), F.length(runs)), F.lit("0"), F.lit(""))
    key = F.concat(F.upper(F.substring(letters, 1, 1)), rest)
    return F.when(letters == "", "").otherwise(F.rpad(F.substring(key, 1, KEY_LENGTH), KEY_LENGTH, "0"))


def phonetic_key_japanese(c: Column, lexicon: dict[str, str] | None = None) -> Column:
    """The key of the romanised text."""
    return phonetic_key(to_romaji(c, lexicon))


def compare_keys(a: Column, b: Column) -> Column:
    """Share of the places in which two keys agree, of the longer one's length; 1 if both are empty, 0 if one is."""
    n = F.greatest(F.length(a), F.length(b))
    agree = F.filter(F.zip_with(F.split(F.rpad(a, n, " "), ""), F.split(F.rpad(b, n, " "), ""), lambda x, y: x == y), lambda z: z)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.size(agree) / n)


def phonetic_similarity(a: Column, b: Column) -> Column:
    """compare_keys of the keys of two texts."""
    return compare_keys(phonetic_key(a), phonetic_key(b))
