"""Building blocks of the SQL that says the same as the operators on names; every function gives an expression as text.

They are written for another engine and by other means than the operators: compatibility forms and case folding from
Python's Unicode tables, the longest common subsequence in bits of a HUGEINT, edit distances over letters that are
renamed within each pair, as the engine counts bytes.
"""

from __future__ import annotations

import sys
import unicodedata

from linkspark.functions import text
from linkspark.functions.kana import SYLLABLES

WS = "[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def _spelled(t: str, table: dict[str, str]) -> str:
    """``t`` with every character of the table spelled out; other texts aren't taken apart."""
    inside = "".join("\\" + c if c in "\\]^-[" else c for c in table)
    listed = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in table.items()) + "}"
    parts = f"list_transform(regexp_extract_all({t}, '[{inside}]|[^{inside}]+'), lambda c: coalesce({listed}[c], c))"
    return f"CASE WHEN regexp_matches({t}, '[{inside}]') THEN array_to_string({parts}, '') ELSE {t} END"


def _characters(keep) -> dict[str, str]:
    found = {}
    for i in range(0x80, min(sys.maxunicode, 0x1FFFF)):
        c = chr(i)
        if unicodedata.category(c) not in ("Cn", "Cs", "Co") and (new := keep(c)) is not None:
            found[c] = new
    return found


def nfkc(t: str) -> str:
    """Compatibility decomposition by table, composition by the engine."""
    table = _characters(lambda c: unicodedata.normalize("NFKD", c) if unicodedata.decomposition(c).startswith("<") else None)
    return f"nfc_normalize({_spelled(t, table)})"


def casefold(t: str) -> str:
    """Lower case, and by table what folds otherwise."""
    return f"lower({_spelled(t, _characters(lambda c: c.casefold() if c.casefold() != c.lower() else None))})"


def strip_forms(t: str, forms: list[str], folded: str | None = None) -> str:
    folded, cases = folded or t, []
    for f in forms:
        k = len(f)
        before, behind = strip(f"substring({t}, 1, greatest(length({t}) - {k}, 0))"), strip(f"substring({t}, {k + 1})")
        cases += [f"WHEN ends_with({folded}, '{f}') AND length({t}) > {k} AND {before} <> '' THEN {before}", f"WHEN starts_with({folded}, '{f}') AND length({t}) > {k} AND {behind} <> '' THEN {behind}"]
    return "CASE " + " ".join(cases) + f" ELSE {t} END"


def normalized(source: str, keys: str) -> str:
    """``keys, t`` from a source ``keys, t``: composed, without legal forms, folded, single blanks."""
    return f"""SELECT {keys}, {collapse('t')} AS t FROM (SELECT {keys}, {strip_forms('t', text.ENGLISH_FORMS)} AS t FROM (
        SELECT {keys}, {strip(casefold('t'))} AS t FROM (SELECT {keys}, {strip_forms('t', text.JAPANESE_FORMS)} AS t FROM (
        SELECT {keys}, {strip(nfkc("coalesce(t, '')"))} AS t FROM ({source})))))"""


def normalized_japanese(source: str, keys: str) -> str:
    return f"""SELECT {keys}, regexp_replace(t, '{WS}+', '', 'g') AS t FROM (SELECT {keys}, {strip_forms('t', text.JAPANESE_FORMS)} AS t FROM (
        SELECT {keys}, {strip(nfkc("coalesce(t, '')"))} AS t FROM ({source})))"""


def normalized_english(source: str, keys: str) -> str:
    return f"""SELECT {keys}, {collapse('t')} AS t FROM (SELECT {keys}, {strip_forms('t', text.ENGLISH_FORMS)} AS t FROM (
        SELECT {keys}, {strip(casefold("coalesce(t, '')"))} AS t FROM ({source})))"""


def romaji(t: str) -> str:
    """Kana by syllables; double consonants and long marks by regular expression."""
    kata, hira = "".join(chr(x) for x in range(0x30A1, 0x30F7)), "".join(chr(x - 0x60) for x in range(0x30A1, 0x30F7))
    pairs = "|".join(k for k in SYLLABLES if len(k) == 2)
    listed = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SYLLABLES.items()) + "}"
    out = f"array_to_string(list_transform(regexp_extract_all(translate(coalesce({t}, ''), {quoted(kata)}, {quoted(hira)}), '(?s:{pairs}|.)'), lambda c: coalesce({listed}[c], c)), '')"
    out = f"replace(regexp_replace({out}, 'っ([b-df-hj-mp-tv-z])', '\\1\\1', 'g'), 'っ', '')"
    for _ in range(3):
        out = f"regexp_replace({out}, '([aiueo])ー', '\\1\\1', 'g')"
    return f"lower(replace({out}, 'ー', ''))"


def phonetic_key(t: str) -> str:
    letters = f"lower(regexp_replace(coalesce({t}, ''), '[^a-zA-Z]', '', 'g'))"
    digits = f"translate({letters}, 'aeiouhwybfpvcgjkqsxzdtlrmn', '00000000111122222222334455')"
    for c in "012345":
        digits = f"regexp_replace({digits}, '{c}+', '{c}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad(substring(upper({letters}[1]) || replace(substring({digits}, 2), '0', ''), 1, 6), 6, '0') END"


def compared_keys(x: str, y: str) -> str:
    agree = f"len(list_filter(range(1, 7), lambda i: substring({x}, i, 1) = substring({y}, i, 1)))"
    return f"CASE WHEN {x} = '' AND {y} = '' THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE {agree} / 6.0 END"


def renamed(source: str, keys: str, a: str, b: str) -> str:
    """The source with ``x, y``: a and b with the letters of the pair renamed to single bytes, which keeps what is equal."""
    letters = f"list_distinct(string_split({a} || {b}, ''))"
    ascii_ = f"array_to_string(list_transform(range(1, len({letters}) + 1), lambda i: chr(i::INT)), '')"
    return f"SELECT {keys}, translate({a}, array_to_string({letters}, ''), {ascii_}) AS x, translate({b}, array_to_string({letters}, ''), {ascii_}) AS y FROM ({source})"


def levenshtein(x: str, y: str) -> str:
    return f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0 ELSE 1 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END"


def jaro_winkler(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' AND {y} = '' THEN 1.0 ELSE jaro_winkler_similarity({x}, {y}) END"


def sorted_words(t: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({t}, '{WS}+'), lambda w: w <> '')), ' ')"


def indel(a: str, b: str) -> str:
    """2 * LCS / both lengths, the LCS bit-parallel in a HUGEINT; for texts of up to 120 characters."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END))::HUGEINT"
    state = f"list_reduce(list_concat([{full}], list_transform(string_split({b}, ''), lambda c: {mask})), lambda s, m: ((s + (s & m)) | (s & ({full} - m))) & {full})"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * (length({a}) - bit_count({state})) / (length({a}) + length({b})) END"


_JAPANESE = f"[{text.HIRAGANA}{text.KATAKANA}{text.IDEOGRAPHS}]"


def language(t: str) -> str:
    return f"""CASE WHEN regexp_replace(coalesce({t}, ''), '{WS}', '', 'g') = '' THEN 'unknown' WHEN regexp_matches({t}, '{_JAPANESE}') THEN 'ja'
        WHEN regexp_matches({t}, '[{text.LATIN_LETTERS}]') THEN 'en' ELSE 'unknown' END"""


def forms(source: str, key: str) -> str:
    """``key, original, language, normalized, romaji, phonetic`` of a source ``key, t``."""
    return f"""SELECT {key}, original, language, normalized, romaji, {phonetic_key('romaji')} AS phonetic FROM (
        SELECT {key}, original, language, normalized, CASE WHEN language = 'ja' THEN {romaji('normalized')} ELSE normalized END AS romaji FROM (
        SELECT o.{key}, coalesce(o.t, '') AS original, {language('o.t')} AS language, CASE WHEN {language('o.t')} = 'ja' THEN j.t ELSE n.t END AS normalized
        FROM ({source}) o JOIN ({normalized_japanese(source, key)}) j ON o.{key} = j.{key} JOIN ({normalized(source, key)}) n ON o.{key} = n.{key}))"""


WEIGHTS = {"jaro_winkler": 0.30, "levenshtein": 0.25, "token_sort": 0.25, "phonetic": 0.20}


def ensemble(pairs: str, key: str) -> str:
    """``key, final_score, <strategies>, best_strategy`` of pairs ``key, q (struct of forms), c (struct of stored forms)``.

    The best pair of forms counts for each strategy; distinct pairs of texts are scored once.
    """
    listed = [("normalized", "name_normalized"), ("normalized", "en_name_normalized"), ("romaji", "name_romaji"), ("romaji", "en_name_normalized"), ("original", "name_normalized")]
    each = ", ".join(f"{{'a': q.{a}, 'b': c.{b}}}" for a, b in listed)
    texts = f"SELECT DISTINCT p.a, p.b FROM (SELECT unnest([{each}]) AS p FROM ({pairs})) WHERE p.a IS NOT NULL AND p.b IS NOT NULL"
    scored = f"""SELECT a, b, {jaro_winkler('x', 'y')} AS jw, {levenshtein('x', 'y')} AS lv, {indel('u', 'v')} AS ts FROM (
        {renamed(f"SELECT a, b, lower(a) AS la, lower(b) AS lb, {sorted_words('a')} AS u, {sorted_words('b')} AS v FROM ({texts})", 'a, b, u, v', 'la', 'lb')})"""
    best = f"""SELECT {key}, max(jw) AS jw, max(lv) AS lv, max(ts) AS ts FROM (SELECT {key}, unnest([{each}]) AS p FROM ({pairs})) e
        JOIN scored s ON e.p.a = s.a AND e.p.b = s.b GROUP BY ALL"""
    keyed = ", ".join(f"{k}" for k in key.split(", "))
    phonetic = f"SELECT {key}, {phonetic_key('q.phonetic')} AS kx, {phonetic_key('c.phonetic_key')} AS ky, c.phonetic_key IS NULL AS none FROM ({pairs})"
    names = ["jaro_winkler", "levenshtein", "token_sort", "phonetic"]
    total = " + ".join(f"{WEIGHTS[n]} * {n}" for n in names)
    return f"""(WITH scored AS MATERIALIZED ({scored}), best AS ({best}),
        sound AS (SELECT {key}, CASE WHEN none THEN 0.0 ELSE {compared_keys('kx', 'ky')} END AS phonetic FROM ({phonetic}))
        SELECT *, ({total}) AS final_score, CASE greatest({', '.join(names)}) WHEN jaro_winkler THEN 'jaro_winkler' WHEN levenshtein THEN 'levenshtein'
        WHEN token_sort THEN 'token_sort' ELSE 'phonetic' END AS best_strategy FROM (
        SELECT {keyed}, coalesce(jw, 0.0) AS jaro_winkler, coalesce(lv, 0.0) AS levenshtein, coalesce(ts, 0.0) AS token_sort, phonetic FROM sound LEFT JOIN best USING ({key})))"""
