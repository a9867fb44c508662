"""Names as comparable text: normalisation, legal forms, trigrams, language and script, all as Column expressions.

Two of the functions, ``nfkc`` and ``casefold``, call the ICU library that Spark ships. Catalyst takes such calls as
non-deterministic and won't merge the projection that holds one with the next; ``with_normalized`` and
``with_normalized_japanese`` use that to evaluate every step once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Japanese legal forms in the order in which they are tried.
JAPANESE_FORMS = [
    "特定非営利活動法人", "公益社団法人", "公益財団法人", "一般社団法人", "一般財団法人", "社会福祉法人",
    "株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "医療法人",
]
# English legal forms in the order in which they are tried.
ENGLISH_FORMS = [
    "kabushiki kaisha", "incorporated", "corporation", "l.l.c.", "company", "limited", "corp.", "corp", "inc.", "inc", "ltd.", "ltd",
    "gmbh", "k.k.", "llc", "plc", "co.", "co", "ag", "bv", "kk", "nv", "sa",
]
# Code point ranges, as the inside of a character class.
HIRAGANA = "\\x{3040}-\\x{309F}"
KATAKANA = "\\x{30A0}-\\x{30FF}\\x{FF65}-\\x{FF9F}\\x{31F0}-\\x{31FF}"
IDEOGRAPHS = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}"
LATIN = "A-Za-z\\x{C0}-\\x{24F}"
LATIN_LETTERS = "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}"
SPACE = "\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}"
#: The share of the characters that makes a script the dominant one.
DOMINANT = 0.8


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; null stays null."""
    return F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def casefold(c: Column) -> Column:
    """Full Unicode case folding; null stays null."""
    return F.try_reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def remove_spaces(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def strip_forms(text: Column, folded: Column, forms: Sequence[str]) -> Column:
    """``text`` without the first legal form of ``forms`` that stands at its end or, failing that, at its start.

    ``text`` has no outer white space and ``folded`` is its folded form. One form is removed at most, there need be no
    word boundary, and a form that is all of the text stays.
    """
    n = F.length(text)

    def before(form: Column) -> Column:
        return strip(F.substring(text, F.lit(1), n - F.length(form)))

    def behind(form: Column) -> Column:
        return strip(F.substring(text, F.length(form) + 1, n))

    def at_end(form: Column) -> Column:
        return F.endswith(folded, form) & (n > F.length(form)) & (before(form) != "")

    fitting = F.filter(F.array(*[F.lit(f) for f in forms]), lambda f: at_end(f) | (F.startswith(folded, f) & (n > F.length(f)) & (behind(f) != "")))
    first = F.get(fitting, F.lit(0))
    # inside a lambda, so that the search is made once
    cut = F.transform(F.array(first), lambda f: F.when(f.isNull(), text).when(at_end(f), before(f)).otherwise(behind(f)))
    return F.get(cut, F.lit(0))


def _staged(df: DataFrame, out: str, *steps: tuple[str, Column]) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    for name, step in steps:
        df = df.withColumn(name, step)
    return df.select(*kept, F.col(steps[-1][0]).alias(out))


def with_normalized(df: DataFrame, source: str, out: str, japanese: Sequence[str] = JAPANESE_FORMS, english: Sequence[str] = ENGLISH_FORMS) -> DataFrame:
    """``df`` with ``out``: composed, without Japanese form, folded, without English form, single blanks; null gives ''."""
    c = lambda i: F.col(f"__n{i}")
    return _staged(
        df, out,
        ("__n0", strip(nfkc(F.coalesce(F.col(source), F.lit(""))))),
        ("__n1", strip_forms(c(0), c(0), japanese)),
        ("__n2", strip(casefold(c(1)))),
        ("__n3", strip_forms(c(2), c(2), english)),
        ("__n4", collapse_spaces(c(3))),
    )


def with_normalized_japanese(df: DataFrame, source: str, out: str, japanese: Sequence[str] = JAPANESE_FORMS) -> DataFrame:
    """``df`` with ``out``: composed, without Japanese form, without white space, case as it is; null gives ''."""
    c = lambda i: F.col(f"__n{i}")
    return _staged(
        df, out,
        ("__n0", strip(nfkc(F.coalesce(F.col(source), F.lit(""))))),
        ("__n1", remove_spaces(strip_forms(c(0), c(0), japanese))),
    )


def with_normalized_english(df: DataFrame, source: str, out: str, english: Sequence[str] = ENGLISH_FORMS) -> DataFrame:
    """``df`` with ``out``: folded, without English form, single blanks; null gives ''."""
    c = lambda i: F.col(f"__n{i}")
    return _staged(
        df, out,
        ("__n0", strip(casefold(F.coalesce(F.col(source), F.lit(""))))),
        ("__n1", collapse_spaces(strip_forms(c(0), c(0), english))),
    )


def trigrams(c: Column) -> Column:
    """The set of three-character pieces of the text between two ``$``; empty for '' and null."""
    padded = F.concat(F.lit("$"), c, F.lit("$"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(c) > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def removed_forms(original_folded: Column, normalized_folded: Column, forms: Sequence[str]) -> Column:
    """The forms found anywhere in the original and nowhere in the normalised text, in their order."""
    listed = F.array(*[F.lit(f) for f in forms])
    return F.filter(listed, lambda f: F.contains(original_folded, f) & ~F.contains(normalized_folded, f))


def is_japanese(c: Column) -> Column:
    """Whether there is a kana or an ideograph."""
    return F.regexp_like(c, F.lit(f"[{HIRAGANA}{KATAKANA}{IDEOGRAPHS}]"))


def is_ideograph(c: Column) -> Column:
    """Whether there is an ideograph."""
    return F.regexp_like(c, F.lit(f"[{IDEOGRAPHS}]"))


def detect_language(c: Column, latin: Column | None = None) -> Column:
    """``ja`` for any kana or ideograph, the label ``latin`` (default ``en``) for Latin letters, else ``unknown``."""
    text = F.coalesce(c, F.lit(""))
    return (
        F.when(strip(text) == "", "unknown")
        .when(is_japanese(text), "ja")
        .when(F.regexp_like(text, F.lit(f"[{LATIN_LETTERS}]")), latin if latin is not None else F.lit("en"))
        .otherwise("unknown")
    )


def script(c: Column) -> Column:
    """The script of at least DOMINANT of the characters that are no white space or punctuation, else ``mixed``."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE}\\p{{P}}]", "")
    n = F.length(text)
    out = F.when(n == 0, "latin")
    for name, inside in (("hiragana", HIRAGANA), ("katakana", KATAKANA), ("kanji", IDEOGRAPHS), ("latin", LATIN)):
        out = out.when(F.regexp_count(text, F.lit(f"[{inside}]")) >= DOMINANT * n, name)
    return out.otherwise("mixed")
