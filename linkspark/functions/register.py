"""The functions under names for SQL, with a prefix: ``SELECT link_jaro_winkler(a, b)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkspark.functions.phonetic import CLASSES, KEY_LENGTH
from linkspark.functions.similarity import indel_ratio_of, jaro_winkler_of
from linkspark.functions.text import HIRAGANA, IDEOGRAPHS, KATAKANA, LATIN_LETTERS, SPACE


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _expressions() -> dict[str, tuple[str, str, str]]:
    """Arguments, type and body of those that are expressions, which Catalyst puts into the query itself."""
    space, japanese = f"[{SPACE}]", f"[{HIRAGANA}{KATAKANA}{IDEOGRAPHS}]"
    source, digits = "".join(CLASSES.values()), "".join(d * len(c) for d, c in CLASSES.items())
    letters = "lower(regexp_replace(coalesce(t, ''), '[^a-zA-Z]', ''))"
    runs = f"regexp_replace(translate({letters}, '{source}', '{digits}'), {_literal(chr(40) + chr(92) + 'd)' + chr(92) + '1+')}, '$1')"
    key = f"rpad(substring(concat(upper(substring({letters}, 1, 1)), replace(substring({runs}, 2), '0', '')), 1, {KEY_LENGTH}), {KEY_LENGTH}, '0')"
    return {
        "collapse_spaces": ("t STRING", "STRING", f"trim(regexp_replace(t, {_literal(space + '+')}, ' '))"),
        "trigrams": ("t STRING", "ARRAY<STRING>", "CASE WHEN length(t) > 0 THEN array_distinct(transform(sequence(1, length(t)), i -> substring(concat('$', t, '$'), i, 3))) ELSE array() END"),
        "phonetic_key": ("t STRING", "STRING", f"CASE WHEN {letters} = '' THEN '' ELSE {key} END"),
        "language": ("t STRING", "STRING", f"CASE WHEN regexp_replace(coalesce(t, ''), {_literal(space)}, '') = '' THEN 'unknown' WHEN regexp_like(t, {_literal(japanese)}) THEN 'ja' WHEN regexp_like(t, {_literal(f'[{LATIN_LETTERS}]')}) THEN 'en' ELSE 'unknown' END"),
        "levenshtein": ("a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)) END"),
    }


def _vectorised(score):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def _token_sort(a: str, b: str) -> float:
    return indel_ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def register_functions(spark: SparkSession, prefix: str = "link_") -> list[str]:
    """Registers all of them for the session and gives their names."""
    names = []
    for name, (arguments, kind, body) in _expressions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body}")
        names.append(prefix + name)
    for name, score in (("jaro_winkler", lambda a, b: jaro_winkler_of(a.lower(), b.lower())), ("token_sort", _token_sort)):
        spark.udf.register(prefix + name, _vectorised(score))
        names.append(prefix + name)
    return names
