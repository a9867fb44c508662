"""One consistent form for text that looks the same but holds different characters (problem 4).

The work is done by SQL that runs in DuckDB inside the Arrow partitions: ``translate`` for compatibility forms, spaces
and hyphens, a regular expression and a map for signs that stand for several characters, a regular expression for what is invisible, ``nfc_normalize`` for composed letters and compatibility
ideographs, and then two passes over words:

* A word of Latin, Greek, Cyrillic and other look-alike letters is read in the script of those of its letters that look
  like no letter of another one, or else of most of its letters; its look-alikes are put into that script. A word wholly
  in one script is left as it is.
* A long mark behind hiragana stays, unless a counter follows.
* A run of katakana and of ideographs that look like katakana is katakana if it holds any katakana and is no single
  look-alike beside ideographs. At its edges, beside ideographs, a look-alike ideograph stays (a line of business or a
  number begins or ends there), but for the one that looks like the long-vowel mark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look alike, in the order of the Latin ones.
LATIN_OF_CYRILLIC = "ABEKMHOPCTXSIJYabeopcyxsijhkmt"
CYRILLIC = "АВЕКМНОРСТХЅІЈУаЬеорсухѕіјһкмт"
LATIN_OF_GREEK = "ABEZHIKMNOPTYXaovuipkt"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονυιρκτ"
# Letters of other scripts that look like Latin ones, in the order of the Latin ones.
LATIN_OF_CHEROKEE = "DRTiYAJEWMHGhZbSVLCPKdB"
CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏂᏃᏏᏚᏙᏞᏟᏢᏦᏧᏴ"
LATIN_OF_LISU = "BPDTGKJCZSRNMLFXHYWVAEIOU"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓢꓣꓠꓟꓡꓝꓫꓧꓬꓪꓦꓮꓰꓲꓳꓴ"
LATIN_OF_COPTIC = "BHIKMNOPCTXaiocx"
COPTIC = "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲁⲓⲟⲥⲭ"
# Katakana and the ideographs that look like them.
KATAKANA = "ーニハカロエタトオヒムメノ"
IDEOGRAPHS = "一二八力口工夕卜才匕厶乂丿"
# Katakana that stand for ideographs when alone beside ideographs, and those that may stand for numerals.
ALONE = "ーニハカロエタ"
# Ideographs that follow a numeral.
COUNTERS = "階十百千丁番号般"
NUMERALS = "一二三四五六七八九十百千〇"

_INVISIBLE = (
    "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}"
    "\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E0FFF}]"
)

_MAPPED = r"[\x{00A0}\x{2000}-\x{206F}\x{2212}\x{2500}-\x{2501}\x{2E80}-\x{2FD5}\x{3000}\x{FE50}-\x{FE6F}\x{FF00}-\x{FFEF}\x{1D400}-\x{1D7FF}]"


def _compatibility() -> tuple[str, str]:
    """Characters and their single-character forms, by rule: full and half widths, radicals, spaces, hyphens."""
    ranges = [(0xFF01, 0xFF5E), (0xFF61, 0xFF9D), (0xFFE0, 0xFFE6), (0x2E80, 0x2FD5), (0x2000, 0x200A), (0x1D400, 0x1D7FF)]
    table = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in ranges for c in range(a, b + 1)}
    table |= {" ": " ", " ": " ", " ": " ", "　": " ", " ": " ", "ﾞ": "゙", "ﾟ": "゚"}
    table |= dict.fromkeys("‐‑‒–—―−─━﹘﹣－⁃", "-")
    pairs = [(a, b) for a, b in table.items() if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Blocks whose compatibility forms have several characters: letter-like signs, numbers, enclosed and squared signs, ligatures.
_SIGNS = [(0x00B2, 0x00BE), (0x2070, 0x209C), (0x2100, 0x218B), (0x2460, 0x24EA), (0x3200, 0x33FF), (0xFB00, 0xFB06)]


def _signs() -> dict[str, str]:
    """Compatibility signs and the letters, digits and ideographs that they stand for, by rule."""
    table = {chr(c): unicodedata.normalize("NFKC", chr(c)).replace("⁄", "/") for a, b in _SIGNS for c in range(a, b + 1)}
    return {a: b for a, b in table.items() if a != b and not b.startswith(" ")}


def _of_capitals(capitals: str, latin: str) -> tuple[str, str]:
    """Small letters that look like no Latin one but whose capitals do: text in lower case holds them."""
    pairs = {a.lower(): b.lower() for a, b in zip(capitals, latin) if a.isupper() and b.isupper() and a.lower() not in capitals}
    return "".join(pairs), "".join(pairs.values())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def consistent_sql(source: str, keys: str) -> str:
    """SQL over ``source(keys, v)`` that gives ``keys, v`` and ``w``, the consistent form of v."""
    compat, plain = _compatibility()
    letters = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Coptic}\p{Cherokee}\p{Lisu}\x{0300}-\x{036F}"
    run = f"ァ-ヺー{IDEOGRAPHS}"
    foreign = r"[\p{Greek}\p{Cyrillic}\p{Coptic}\p{Cherokee}\p{Lisu}]"
    own_latin = "[" + "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in LATIN_OF_CYRILLIC + LATIN_OF_GREEK) + "]"
    small = {"Cyrillic": _of_capitals(CYRILLIC, LATIN_OF_CYRILLIC), "Greek": _of_capitals(GREEK, LATIN_OF_GREEK)}
    strange = lambda script, known: f"regexp_matches(translate(t, {_q(known + small[script][0])}, ''), '\\p{{{script}}}')"
    to_latin = f"translate(translate(t, {_q(CYRILLIC)}, {_q(LATIN_OF_CYRILLIC)}), {_q(GREEK)}, {_q(LATIN_OF_GREEK)})"
    rare = f"translate({to_latin}, {_q(CHEROKEE + LISU + COPTIC)}, {_q(LATIN_OF_CHEROKEE + LATIN_OF_LISU + LATIN_OF_COPTIC)})"
    all_latin = f"CASE WHEN length(t) > 2 THEN translate({rare}, {_q(small['Cyrillic'][0] + small['Greek'][0])}, {_q(small['Cyrillic'][1] + small['Greek'][1])}) ELSE {rare} END"
    first_of = lambda s: (" ".join(dict.fromkeys(s)).replace(" ", ""))
    back = {}
    for name, latin, own in (("cyrillic", LATIN_OF_CYRILLIC, CYRILLIC), ("greek", LATIN_OF_GREEK, GREEK)):
        chosen = first_of(latin)
        back[name] = f"translate({to_latin}, {_q(chosen)}, {_q(''.join(own[latin.index(c)] for c in chosen))})"
    count = lambda script: f"length(regexp_replace(t, '\\P{{{script}}}', '', 'g'))"
    word = f"""CASE
        WHEN NOT regexp_matches(t, '{foreign}') THEN t
        WHEN (regexp_matches(t, '\\p{{Latin}}')::INT + regexp_matches(t, '\\p{{Greek}}')::INT + regexp_matches(t, '\\p{{Cyrillic}}')::INT
              + regexp_matches(t, '\\p{{Coptic}}')::INT + regexp_matches(t, '\\p{{Cherokee}}')::INT + regexp_matches(t, '\\p{{Lisu}}')::INT) < 2 THEN t
        WHEN regexp_matches(t, '{own_latin}') THEN {all_latin}
        WHEN {strange('Cyrillic', CYRILLIC)} THEN {back['cyrillic']}
        WHEN {strange('Greek', GREEK)} THEN {back['greek']}
        WHEN {count('Latin')} >= {count('Cyrillic')} + {count('Greek')} THEN {all_latin}
        WHEN {count('Cyrillic')} > {count('Greek')} THEN {back['cyrillic']}
        ELSE {back['greek']} END"""
    to_kana = lambda x: f"translate({x}, {_q(IDEOGRAPHS)}, {_q(KATAKANA)})"
    to_han = lambda x: f"translate({x}, {_q(KATAKANA)}, {_q(IDEOGRAPHS)})"
    head, tail = f"regexp_extract(t, '^[{IDEOGRAPHS}]*')", f"regexp_extract(t, '[{IDEOGRAPHS}]*$')"
    middle = f"t[length({head}) + 1 : length(t) - length({tail})]"
    ideograph = r"[\p{Han}]"
    counted = f"regexp_matches(after, '^[{COUNTERS}]') AND regexp_matches(t, '[一二八]$')"
    kana = f"""CASE
        WHEN NOT regexp_matches(t, '^[{run}]') THEN t
        WHEN t IN ('ー', '一') AND regexp_matches(before, '[0-9]$') AND regexp_matches(after, '^[0-9]') THEN '-'
        WHEN t = 'ー' AND regexp_matches(before, '\\p{{Latin}}$') AND regexp_matches(after, '^\\p{{Latin}}') THEN '-'
        WHEN t = 'ー' AND regexp_matches(before, '[{NUMERALS}]$') AND regexp_matches(after, '^[{NUMERALS}]') THEN '-'
        WHEN t = 'ー' AND regexp_matches(before, '[ぁ-ゖ]$') AND NOT regexp_matches(after, '^[{COUNTERS}]') THEN t
        WHEN length(t) = 1 AND regexp_matches(t, '[{ALONE}]')
             AND (regexp_matches(before, '{ideograph}$') OR regexp_matches(after, '^{ideograph}')) THEN {to_han('t')}
        WHEN regexp_matches(t, '^[ニハ二八一]+$') AND regexp_matches(t, '[ニハ]')
             AND (regexp_matches(before, '[{NUMERALS}]$') OR regexp_matches(after, '^[{COUNTERS}]')) THEN {to_han('t')}
        WHEN NOT regexp_matches(t, '[ァ-ヺー]') OR NOT regexp_matches(t, '[{IDEOGRAPHS}]') THEN t
        ELSE CASE WHEN regexp_matches(before, '{ideograph}$') THEN {head} ELSE {to_kana(head)} END
             || {to_kana(middle)}
             || CASE WHEN {counted} THEN {to_kana(f'{tail}[1 : length({tail}) - 1]')} || {tail}[-1]
                     WHEN regexp_matches({tail}, '一$') THEN {to_kana(tail)} ELSE {tail} END
        END"""
    # translate builds its table for every value, so only values that hold such a character go there
    mapped = f"CASE WHEN regexp_matches(v, '{_MAPPED}') THEN translate(v, {_q(compat)}, {_q(plain)}) ELSE v END"
    signs = _signs()
    sign = "[" + "".join(signs) + "]"
    listed = "MAP {" + ", ".join(f"{_q(a)}: {_q(b)}" for a, b in signs.items()) + "}"
    spelled = f"array_to_string(list_transform(regexp_extract_all(m, '{sign}|[^{sign[1:-1]}]+'), lambda t: coalesce({listed}[t], t)), '')"
    whole = f"CASE WHEN regexp_matches(m, '{sign}') THEN {spelled} ELSE m END"
    folded = f"nfc_normalize(regexp_replace({whole}, '{_INVISIBLE}', '', 'g'))"
    words = f"array_to_string(list_transform(regexp_extract_all(u, '[{letters}]+|[^{letters}]+'), lambda t: {word}), '')"
    neighbours = "{'t': t, 'before': CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END, 'after': coalesce(ws[i + 1], '')}"
    runs = f"""array_to_string(list_transform([regexp_extract_all(u, '[{run}]+|[^{run}]+')], lambda ws: list_transform(
        list_transform(ws, lambda t, i: {neighbours}), lambda y: {_fields(kana)}))[1], '')"""
    # most values hold nothing that the passes over words could change
    apart = "[^ァ-ヺー]"
    doubtful = f"regexp_matches(u, '[{IDEOGRAPHS}]|(^|{apart})([{ALONE}]|[ニハ]+)({apart}|$)')"
    return f"""
    WITH m AS (SELECT {keys}, v, {mapped} AS m FROM {source}),
    a AS (SELECT {keys}, v, {folded} AS u FROM m),
    b AS (SELECT {keys}, v, CASE WHEN regexp_matches(u, '{foreign}') THEN {words} ELSE u END AS u FROM a)
    SELECT {keys}, v, CASE WHEN {doubtful} THEN nfc_normalize({runs}) ELSE u END AS w FROM b"""


def _fields(expression: str) -> str:
    """The expression over t, before and after, read from the struct y."""
    return re.sub(r"\b(t|before|after)\b(?=[^']*(?:'[^']*'[^']*)*$)", r"y.\1", expression)


def _connection():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})


def consistent_values(df: DataFrame, id_column: str, fields: Sequence[str]) -> DataFrame:
    """``(<id_column>, field_name, value, consistent)``: a row for each row of ``df`` and field with a value.

    Defined cases: a null has no row; the empty string is consistent; repeated rows count each; other columns are
    ignored, whatever their names.
    """
    kind = df.schema[id_column].dataType.simpleString()
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        # a value is folded once for a batch, however often it stands there
        source = " UNION ALL ".join(f"SELECT k, {_q(n)} AS f, f{i} AS v FROM batch WHERE f{i} IS NOT NULL" for i, n in enumerate(names))
        sql = consistent_sql(f"({source})", "k, f")
        schema = None
        for b in batches:
            batch = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, ["k", *[f"f{i}" for i in range(len(names))]])])
            con.register("batch", batch)
            out = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            schema = pa.schema([(id_column, b.schema.field(0).type), ("field_name", pa.string()), ("value", pa.string()), ("consistent", pa.string())])
            yield from out.rename_columns(schema.names).cast(schema).to_batches()

    chosen = df.select(F.col(id_column).alias("k"), *[F.col(n).cast("string").alias(f"f{i}") for i, n in enumerate(names)])
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, field_name string, value string, consistent string")


def with_consistent(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``df`` with the fields in their consistent form; nulls stay null."""
    names = list(fields)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        source = " UNION ALL ".join(f"SELECT k, {i} AS f, f{i} AS v FROM batch WHERE f{i} IS NOT NULL" for i in range(len(names)))
        sql = f"SELECT k, f, w FROM ({consistent_sql(f'({source})', 'k, f')})"
        numbers, chosen = ", ".join(str(i) for i in range(len(names))), ", ".join(f'p."{i}"' for i in range(len(names)))
        for b in batches:
            at = [b.schema.get_field_index(n) for n in names]
            batch = pa.table([pa.array(range(b.num_rows), pa.int64()), *[b.column(i).cast(pa.string()) for i in at]], names=["k", *[f"f{i}" for i in range(len(names))]])
            con.register("batch", batch)
            wide = con.sql(f"SELECT {chosen} FROM batch LEFT JOIN (PIVOT ({sql}) ON f IN ({numbers}) USING any_value(w) GROUP BY k) p ON batch.k = p.k ORDER BY batch.k").to_arrow_table()
            con.unregister("batch")
            new = [wide.column(x).combine_chunks() for x in range(len(names))]
            columns = list(b.columns)
            for i, values in zip(at, new):
                columns[i] = values.cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, schema)


def disguised(df: DataFrame, id_column: str = "id", fields: Sequence[str] = ("name", "name_normalized", "address")) -> DataFrame:
    """``(<id_column>, field_name)`` of the stored values that aren't in the consistent form."""
    return consistent_values(df, id_column, fields).where("consistent <> value").select(id_column, "field_name")
