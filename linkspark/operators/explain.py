"""Explanation steps as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "struct<step:string,description:string,input_value:string,output_value:string,details:map<string,string>>"


def step(name: str, description: Column, input_value: Column | None, output_value: Column, **details: Column) -> Column:
    """One step; details are given as strings, lists and maps as JSON."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    kept = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(name).alias("step"), description.alias("description"), (input_value if input_value is not None else F.lit(None)).cast("string").alias("input_value"),
        output_value.cast("string").alias("output_value"), kept.alias("details"),
    )


def _listed(c: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))


def query_steps(prefix: str = "q_") -> Column:
    """Language, normalisation, transliteration (Japanese only) and phonetic key of a query with its forms."""
    c = lambda name: F.col(f"{prefix}{name}")
    ja = c("language") == "ja"
    language = step("language_detection", F.format_string("Detected language '%s' (script: %s)", c("language"), c("script")), c("original"), c("language"), script=c("script"))
    found = F.when(F.size(c("suffixes_removed")) > 0, F.concat(F.lit("Normalized text, removed suffixes: "), _listed(c("suffixes_removed")))).otherwise("Normalized text")
    normal = step("normalization", found, c("original"), c("normalized"), suffixes_removed=F.to_json(c("suffixes_removed")))
    roman = step("transliteration", F.format_string("Transliterated to romaji with %d variant(s)", F.size(c("variants"))), c("normalized"), c("romaji"), variants=F.to_json(c("variants")))
    key = step("phonetic_encoding", F.format_string("Generated phonetic key '%s'", c("phonetic")), F.when(ja, c("romaji")).otherwise(c("normalized")), c("phonetic"))
    return F.filter(F.array(language, normal, F.when(ja, roman), key), lambda s: s.isNotNull())


def blocking_step(total: Column, trigram: Column, phonetic: Column) -> Column:
    """The step of candidate retrieval. Its first counts are the service's (all, and none); the true ones follow."""
    said = F.format_string("Blocking retrieved %d unique candidates (trigram: %d, phonetic: 0)", total, total)
    return step("blocking", said, None, total, trigram_candidates=total, phonetic_candidates=F.lit(0), total_unique=total, trigram_channel=trigram, phonetic_channel=phonetic)


def scoring_step(name: Column, score: Column, results: Column) -> Column:
    """The step of a kept match."""
    scores = F.map_from_entries(F.transform(results, lambda r: F.struct(r.strategy_name, r.score)))
    shown = F.format_string("%.4f", score)
    return step("scoring", F.concat(F.lit("Scored '"), name, F.lit("' -> "), shown), name, shown, strategy_scores=F.to_json(scores))
