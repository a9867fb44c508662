"""The forms in which a query's text is looked up and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions.phonetic import phonetic_key
from linkspark.functions.romaji import romaji_variants, to_romaji
from linkspark.functions.text import casefold, detect_language, removed_forms, script, with_normalized, with_normalized_japanese
from linkspark.operators.entity_types import COMPANY, EntityTypeConfig

FORMS = ("original", "normalized", "romaji", "phonetic")


def with_query_forms(df: DataFrame, text: str, config: EntityTypeConfig = COMPANY, prefix: str = "q_", lexicon: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``<prefix>original, language, script, normalized, romaji, phonetic, variants, suffixes_removed``.

    Japanese text is normalised the Japanese way and romanised; other text is normalised in full and is its own
    romanisation. No form is null; a null text counts as ''. Variants are listed for Japanese text only.
    """
    p = lambda name: f"{prefix}{name}"
    out = df.withColumn(p("original"), F.coalesce(F.col(text), F.lit("")))
    out = with_normalized_japanese(out, p("original"), "__ja", config.japanese_forms)
    out = with_normalized(out, p("original"), "__other", config.japanese_forms, config.english_forms)
    out = out.withColumns({p("language"): detect_language(F.col(p("original"))), p("script"): script(F.col(p("original")))})
    ja = F.col(p("language")) == "ja"
    out = out.withColumn(p("normalized"), F.when(ja, F.col("__ja")).otherwise(F.col("__other"))).drop("__ja", "__other")
    out = out.withColumn(p("romaji"), F.when(ja, to_romaji(F.col(p("normalized")), lexicon)).otherwise(F.col(p("normalized"))))
    out = out.withColumns({"__fo": casefold(F.col(p("original"))), "__fn": casefold(F.col(p("normalized")))})
    removed = F.when(ja, removed_forms(F.col("__fo"), F.col("__fn"), config.japanese_forms)).otherwise(removed_forms(F.col("__fo"), F.col("__fn"), config.english_forms))
    variants = F.when(ja, romaji_variants(F.col(p("romaji")))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({p("phonetic"): phonetic_key(F.col(p("romaji"))), p("variants"): variants, p("suffixes_removed"): removed}).drop("__fo", "__fn")
