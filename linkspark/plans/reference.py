"""Driver queries over the operators on names and registries, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.functions import phonetic, romaji, similarity, text
from linkspark.functions.register import register_functions
from linkspark.operators.blocking import candidates, ngram_index, phonetic_block, trigram_block
from linkspark.operators.entity_types import COMPANY
from linkspark.operators.forms import with_query_forms
from linkspark.operators.readings import COMMON_WORDS, company_lexicon, lexicon_of
from linkspark.operators.resolver import Resolver, compare, dedupe_pairs, unmatched, validated
from linkspark.operators.service import batch_results
from linkspark.plans import sql
from linkspark.settings import ResolverSettings
from linkspark.sources.registry import by_ids, latest_lines, not_yet_there, numbered, prepare_entities, registry_rows, stats
from linkspark.sources.tables import cut, table

SETTINGS = ResolverSettings()


def _companies(s, d):
    return table(s, d, "companies")


def _postings(s, d):
    """The n-gram index as it is stored, with repeated postings."""
    return table(s, d, "company_ngrams").select(F.col("company_id").alias("entity_id"), "ngram", "source_field")


def _requests(s, d):
    return validated(table(s, d, "search_requests"), SETTINGS)


def _resolver(s, d, lexicon=None):
    return Resolver(_companies(s, d), _postings(s, d), COMPANY, SETTINGS, lexicon=lexicon, repeated_postings=True)


_COUPLES = (("name", "name_normalized"), ("name", "furigana"), ("name_romaji", "en_name_normalized"), ("en_name", "en_name_normalized"))


def _name_pairs(s, d):
    """Texts of every company beside each other; one that is null has no score."""
    couples = F.array(*[F.struct(F.lit(i).alias("couple"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(_COUPLES)])
    return _companies(s, d).select("id", F.inline(couples))


def _suffixed(s, d, forms, japanese):
    n = len(forms)
    listed = F.array(*[F.lit(x) for x in forms])
    form = F.get(listed, (F.col("s_suppkey") % n).cast("int"))
    name = F.col("s_name")
    text_ = F.when(F.col("s_suppkey") % 2 == 0, F.concat(form, name)).otherwise(F.concat(name, form)) if japanese else F.concat(name, F.lit(" "), form)
    return table(s, d, "supplier").select("s_suppkey", text_.alias("t"))


def _strip(df, forms):
    t = text.strip(F.col("t"))
    return df.select("s_suppkey", "t", text.strip_forms(t, F.lower(t), forms).alias("stripped"))


# Inline rows: words of ideographs and kana, and their romanisation.
_WORDS = [("東京", "toukyou"), ("東京銀行", "toukyouginkou"), ("ソニー東京株式会社", "soniitoukyoukabushikigaisha"), ("三菱電機", "mitsubishidenki"), ("大阪ガス", "oosakagasu"), ("Sony", "sony"), ("", "")]


def _forms(s, d):
    asked = _requests(s, d).where("status = 'ok'").groupBy("text").agg(F.min("query_id").alias("query_id"))
    return with_query_forms(asked, "text")


def _lookup(s, d):
    """Queries in the stored normalised form, so that SQL can say the same: distinct texts of requests, in lower case."""
    t = F.trim(F.regexp_replace(F.lower("query_text"), "[ \\t\\n]+", " "))
    return table(s, d, "search_requests").where("query_text IS NOT NULL AND length(query_text) <= 200").select(t.alias("q_normalized"), "query_id").where("q_normalized <> ''").groupBy("q_normalized").agg(F.min("query_id").alias("query_id"))


def _lookup_forms(s, d):
    q = _lookup(s, d)
    return q.select("query_id", "q_normalized", F.replace(F.col("q_normalized"), F.lit(" "), F.lit("")).alias("q_romaji"), phonetic.phonetic_key(F.col("q_normalized")).alias("q_phonetic"))


def _explained(s, d):
    out = _resolver(s, d).matches(_requests(s, d), explain=True)
    kinds = F.array_join(F.transform("explanations", lambda x: x.step), ",")
    return out.select("query_id", "rank", "entity_id", F.size("explanations").alias("n_steps"), kinds.alias("steps"), F.element_at("explanations", -1).input_value.alias("last_name"))


def _resolved(s, d, lexicon=None):
    return _resolver(s, d, lexicon).matches(_requests(s, d)).select("query_id", "rank", "entity_id", "entity_name", F.round("score", 6).alias("score"), "band", "best_strategy")


def _compared(s, d):
    pairs = _companies(s, d).select("id", F.col("name").alias("name_a"), F.col("en_name").alias("name_b"))
    out = compare(pairs)
    scores = [F.round(F.get("strategy_results", F.lit(i)).getField("score"), 6).alias(n) for i, n in enumerate(("jaro_winkler", "levenshtein", "token_sort", "phonetic"))]
    return out.select("id", F.round("final_score", 6).alias("final_score"), *scores, "best_strategy")


def _sql_functions(s, d):
    register_functions(s)
    _companies(s, d).createOrReplaceTempView("linkspark_companies")
    return s.sql("""SELECT id, link_collapse_spaces(name) AS spaced, array_join(array_sort(link_trigrams(name_normalized)), '|') AS grams, link_phonetic_key(name_romaji) AS key,
        link_language(name) AS language, round(link_levenshtein(name, name_normalized), 6) AS edits, round(link_jaro_winkler(name, name_normalized), 6) AS winkler,
        round(link_token_sort(name_romaji, en_name_normalized), 6) AS tokens FROM linkspark_companies""")


QUERIES = {
    "collapse_ws": lambda s, d: _companies(s, d).select("id", text.collapse_spaces(F.col("name")).alias("t")),
    "strip_suffix_en": lambda s, d: _strip(_suffixed(s, d, text.ENGLISH_FORMS, False), text.ENGLISH_FORMS),
    "strip_suffix_ja": lambda s, d: _strip(_suffixed(s, d, text.JAPANESE_FORMS, True), text.JAPANESE_FORMS),
    "normalize_name": lambda s, d: text.with_normalized(_companies(s, d).select("id", "name"), "name", "normalized"),
    "normalize_japanese": lambda s, d: text.with_normalized_japanese(_companies(s, d).select("id", "name"), "name", "normalized"),
    "normalize_english": lambda s, d: text.with_normalized_english(_companies(s, d).select("id", "en_name"), "en_name", "normalized"),
    "removed_suffixes": lambda s, d: _strip(_suffixed(s, d, text.ENGLISH_FORMS, False), text.ENGLISH_FORMS).select("s_suppkey", F.array_join(text.removed_forms(F.lower("t"), F.lower("stripped"), text.ENGLISH_FORMS), "|").alias("removed")),
    "trigrams": lambda s, d: ngram_index(_companies(s, d), COMPANY.ngram_fields),
    "language_detect": lambda s, d: _companies(s, d).select("id", text.detect_language(F.col("name")).alias("language"), text.is_japanese(F.col("name")).alias("japanese"), text.is_ideograph(F.col("name")).alias("ideograph")),
    "script_detect": lambda s, d: _companies(s, d).select("id", text.script(F.col("name")).alias("script")),
    "kana_romaji": lambda s, d: _companies(s, d).select("id", romaji.to_romaji(F.col("furigana")).alias("romaji")),
    "place_romaji": lambda s, d: table(s, d, "prefectures").select("prefecture_code", romaji.to_romaji(F.col("pref_name"), lexicon_of(table(s, d, "prefectures"), "pref_name", "pref_romaji")).alias("romaji")),
    "word_romaji": lambda s, d: s.createDataFrame([(w,) for w, _ in _WORDS], "w string").select("w", romaji.to_romaji(F.col("w"), COMMON_WORDS).alias("romaji")),
    "name_romaji": lambda s, d: _companies(s, d).select("id", romaji.to_romaji(F.col("name"), company_lexicon(_companies(s, d))).alias("romaji")),
    "romaji_variants": lambda s, d: _companies(s, d).select("id", F.array_join(romaji.romaji_variants(F.col("name_romaji")), ",").alias("variants")),
    "phonetic_key": lambda s, d: _companies(s, d).select("id", phonetic.phonetic_key(F.col("name_romaji")).alias("key")),
    "sim_levenshtein": lambda s, d: _name_pairs(s, d).select("id", "couple", F.round(similarity.levenshtein(F.col("a"), F.col("b")), 6).alias("score")),
    "sim_jaro_winkler": lambda s, d: _name_pairs(s, d).select("id", "couple", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 6).alias("score")),
    "sim_token_sort": lambda s, d: _name_pairs(s, d).select("id", "couple", F.round(similarity.token_sort(F.col("a"), F.col("b")), 6).alias("score")),
    "sim_phonetic": lambda s, d: _name_pairs(s, d).select("id", "couple", F.round(phonetic.phonetic_similarity(F.col("a"), F.col("b")), 6).alias("score")),
    "ensemble_compare": _compared,
    "query_forms": lambda s, d: _forms(s, d).select("query_id", "q_language", "q_script", "q_normalized", "q_romaji", "q_phonetic", F.array_join("q_variants", ",").alias("q_variants"), F.array_join("q_suffixes_removed", ",").alias("q_removed")),
    "ngram_index": lambda s, d: ngram_index(_companies(s, d), COMPANY.ngram_fields).groupBy("source_field", "ngram").count().withColumnRenamed("count", "n"),
    "trigram_block_topk": lambda s, d: trigram_block(_lookup(s, d), "q_normalized", _postings(s, d), SETTINGS.trigram_candidate_limit, repeated=True),
    "phonetic_block_topk": lambda s, d: phonetic_block(_lookup_forms(s, d), "q_phonetic", _companies(s, d), SETTINGS.phonetic_candidate_limit),
    "candidates_union": lambda s, d: candidates(_lookup_forms(s, d), _companies(s, d), _postings(s, d), SETTINGS, repeated=True).select("query_id", "entity_id", "channel", "channel_rank", "cand_ord"),
    "request_validation": lambda s, d: _requests(s, d).select("query_id", "limit", "status", "error"),
    "resolve_topk": _resolved,
    "resolve_with_readings": lambda s, d: _resolved(s, d, company_lexicon(_companies(s, d))),
    "explain_running": _explained,
    "batch_resolve": lambda s, d: batch_results(_resolver(s, d), table(s, d, "search_requests")).select("query_id", F.size("matches").alias("n_matches"), "total_candidates", "status", "error"),
    "score_bands": lambda s, d: _resolved(s, d).groupBy("band").count().withColumnRenamed("count", "n"),
    "sql_functions": _sql_functions,
    # the stated query set of searches: every entity whose id is divisible by 50, against all
    "dedupe_pairs": lambda s, d: dedupe_pairs(_resolver(s, d), _companies(s, d).where("id % 50 = 0"), 0.7).withColumn("score", F.round("score", 6)),
    "unmatched_anti": lambda s, d: unmatched(_requests(s, d), cut(_resolver(s, d).matches(_requests(s, d)).select("query_id"))).select("query_id", "status"),
    "entity_projection": lambda s, d: COMPANY.project(_companies(s, d)),
    "lookup_by_ids": lambda s, d: by_ids(_companies(s, d), COMPANY, table(s, d, "search_requests").select("query_id", (-F.col("query_id")).alias("ord")), "query_id").select("id", "corporate_number", "name"),
    "registry_stats": lambda s, d: stats({"company": (_companies(s, d), table(s, d, "company_ngrams"))}),
    "ingest_first_wins": lambda s, d: latest_lines(registry_rows(table(s, d, "registry_rows"))),
    "ingest_ids": lambda s, d: numbered(latest_lines(registry_rows(table(s, d, "registry_rows"))).select("row_no", "corporate_number"), "row_no"),
    "ingest_into_standing": lambda s, d: not_yet_there(latest_lines(registry_rows(table(s, d, "registry_rows"))), _companies(s, d)),
    "ingest_prepared": lambda s, d: prepare_entities(latest_lines(registry_rows(table(s, d, "registry_rows")))),
}


def _sql_list(forms):
    return "[" + ", ".join("'" + f + "'" for f in forms) + "]"


_WS, _sql_key = sql.WS, sql.phonetic_key


def _sql_strip(t, forms, folded):
    return sql.strip_forms(t, forms, folded)


_EN = f"SELECT s_suppkey, s_name || ' ' || list_extract({_sql_list(text.ENGLISH_FORMS)}, CAST(s_suppkey % {len(text.ENGLISH_FORMS)} AS INT) + 1) AS t FROM supplier"
_JA_FORM = f"list_extract({_sql_list(text.JAPANESE_FORMS)}, CAST(s_suppkey % {len(text.JAPANESE_FORMS)} AS INT) + 1)"
_JA = f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN {_JA_FORM} || s_name ELSE s_name || {_JA_FORM} END AS t FROM supplier"
_EN_STRIPPED = f"SELECT s_suppkey, t, {_sql_strip('t', text.ENGLISH_FORMS, 'lower(t)')} AS stripped FROM ({_EN})"


_GRAMS = "list_distinct(list_transform(range(1, length(T) + 1), lambda i: substring('$' || T || '$', i, 3)))"
_PAIRS = " UNION ALL ".join(f"SELECT id, {i} AS couple, {a} AS a, {b} AS b FROM companies" for i, (a, b) in enumerate(_COUPLES))
_LOWERED = sql.renamed(f"SELECT id, couple, lower(a) AS a, lower(b) AS b FROM ({_PAIRS})", "id, couple", "a", "b")
_LOOKUP = """lookup AS (SELECT q_normalized, min(query_id) AS query_id FROM (
  SELECT trim(regexp_replace(lower(query_text), '[ \\t\\n]+', ' ', 'g')) AS q_normalized, query_id FROM search_requests
  WHERE query_text IS NOT NULL AND length(query_text) <= 200) WHERE q_normalized <> '' GROUP BY q_normalized)"""
_FORMS = f"{_LOOKUP}, forms AS (SELECT query_id, q_normalized, replace(q_normalized, ' ', '') AS q_romaji, {_sql_key('q_normalized')} AS q_phonetic FROM lookup)"
_POSTINGS = "postings AS (SELECT DISTINCT company_id AS entity_id, ngram, source_field FROM company_ngrams)"


def _sql_block(source, t):
    return f"""SELECT query_id, entity_id, match_count, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_count DESC, entity_id) AS rank FROM (
        SELECT query_id, entity_id, count(*) AS match_count FROM
          (SELECT query_id, unnest({_GRAMS.replace('T', t)}) AS ngram FROM {source}) JOIN postings USING (ngram) GROUP BY ALL)) WHERE rank <= 200"""


_PHONETIC = """SELECT query_id, entity_id, rank FROM (SELECT query_id, substring(q_phonetic, 1, 4) AS p FROM forms WHERE q_phonetic <> '')
  JOIN (SELECT id AS entity_id, substring(phonetic_key, 1, 4) AS p,
               row_number() OVER (PARTITION BY substring(phonetic_key, 1, 4) ORDER BY id) AS rank FROM companies WHERE phonetic_key <> '') USING (p)
  WHERE rank <= 100"""


def _count(inside):
    return f"len(regexp_extract_all(t, '[{inside}]'))"


_JAPANESE = f"[{text.HIRAGANA}{text.KATAKANA}{text.IDEOGRAPHS}]"

_FIRST_LINES = f"""SELECT row_no, corporate_number, name, nullif(furigana, '') AS furigana, nullif(prefecture_code, '') AS prefecture_code, nullif(city, '') AS city,
        nullif(address, '') AS address, nullif(en_name, '') AS en_name FROM (
        SELECT *, row_number() OVER (PARTITION BY corporate_number ORDER BY row_no) AS i FROM (
          SELECT row_no, {', '.join(f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g') AS {n}" for n, c in (('corporate_number', 'c1'), ('latest', 'c3'), ('name', 'c6'), ('furigana', 'c7'), ('prefecture_code', 'c8'), ('city', 'c9'), ('address', 'c10'), ('en_name', 'c24')))}
          FROM registry_rows WHERE c8 IS NOT NULL) WHERE latest = '0' AND corporate_number <> '' AND name <> '') WHERE i = 1"""

_COMPARED = f"""SELECT a.id, {{'original': a.original, 'normalized': a.normalized, 'romaji': a.romaji, 'phonetic': a.phonetic}} AS q,
    {{'name_normalized': b.normalized, 'en_name_normalized': b.normalized, 'name_romaji': b.romaji, 'phonetic_key': b.phonetic}} AS c
    FROM ({sql.forms('SELECT id, name AS t FROM companies', 'id')}) a JOIN ({sql.forms('SELECT id, en_name AS t FROM companies', 'id')}) b ON a.id = b.id"""

_LETTERS = "regexp_replace(coalesce(name, ''), '[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}\\p{P}]', '', 'g')"
_SCRIPT = f"""CASE WHEN length(t) = 0 THEN 'latin' WHEN {_count(text.HIRAGANA)} >= 0.8 * length(t) THEN 'hiragana'
        WHEN {_count(text.KATAKANA)} >= 0.8 * length(t) THEN 'katakana' WHEN {_count(text.IDEOGRAPHS)} >= 0.8 * length(t) THEN 'kanji'
        WHEN {_count(text.LATIN)} >= 0.8 * length(t) THEN 'latin' ELSE 'mixed' END"""
_VALIDATED = """SELECT query_id, text, coalesce(max_results, 10) AS "limit", CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error FROM (
        SELECT *, query_text AS text, CASE WHEN query_text IS NULL OR length(query_text) < 1 THEN 'query is missing' WHEN length(query_text) > 200 THEN 'query is too long'
        WHEN coalesce(max_results, 10) < 1 OR coalesce(max_results, 10) > 50 THEN 'limit is out of range' END AS error FROM search_requests)"""
# candidates of forms (query_id, q_normalized, q_romaji, q_phonetic)
_CANDIDATES = f"""seen AS (
        SELECT query_id, entity_id, 1 AS channel, rank FROM ({_sql_block('forms', 'q_normalized')})
        UNION ALL SELECT query_id, entity_id, 2, rank FROM ({_sql_block("(SELECT * FROM forms WHERE q_romaji <> q_normalized)", 'q_romaji')})
        UNION ALL SELECT query_id, entity_id, 3, rank FROM ({_PHONETIC})),
    firsts AS (SELECT query_id, entity_id, min({{'c': channel, 'r': rank}}) AS f FROM seen GROUP BY ALL),
    candidates AS (SELECT query_id, entity_id, f.c AS channel, f.r AS channel_rank, row_number() OVER (PARTITION BY query_id ORDER BY f.c, f.r) AS cand_ord FROM firsts)"""


def _sql_variants(t):
    pairs = [("ou", "o"), ("oo", "o"), ("uu", "u"), ("ii", "i"), ("ei", "e"), ("ee", "e"), ("aa", "a")]
    every = t
    for a, b in pairs:
        every = f"replace({every},'{a}','{b}')"
    last = t
    for v in "aiueo":
        last = f"regexp_replace({last},'{v}{v}+$','{v}')"
    listed = f"[{t}, {every}, {', '.join(f"replace({t},'{a}','{b}')" for a, b in pairs)}, {last}]"
    return f"CASE WHEN {t} = '' THEN '' ELSE array_to_string(list_reduce(list_transform({listed}, lambda x: [x]), lambda s, x: CASE WHEN list_contains(s, x[1]) THEN s ELSE list_concat(s, x) END), ',') END"


def _sql_removed(original, normalized, forms):
    return f"array_to_string(list_filter({_sql_list(forms)}, lambda f: contains({original}, f) AND NOT contains({normalized}, f)), ',')"


# the forms of every distinct text that is asked for
_SEARCHED = f"""requests AS ({_VALIDATED}), texts AS (SELECT text AS t, min(query_id) AS query_id FROM requests WHERE status = 'ok' GROUP BY text),
    forms AS MATERIALIZED (SELECT query_id, original, language, normalized AS q_normalized, romaji AS q_romaji, phonetic AS q_phonetic,
        CASE WHEN language = 'ja' THEN {_sql_variants('romaji')} ELSE '' END AS q_variants,
        coalesce(CASE WHEN language = 'ja' THEN {_sql_removed('fo', 'fn', text.JAPANESE_FORMS)} ELSE {_sql_removed('fo', 'fn', text.ENGLISH_FORMS)} END, '') AS q_removed
        FROM (SELECT *, {sql.casefold('original')} AS fo, {sql.casefold('normalized')} AS fn FROM ({sql.forms('SELECT query_id, t FROM texts', 'query_id')})))"""
_MEETING = """SELECT k.query_id, entity_id, {'original': original, 'normalized': q_normalized, 'romaji': q_romaji, 'phonetic': q_phonetic} AS q,
    {'name_normalized': coalesce(name_normalized, ''), 'en_name_normalized': nullif(en_name_normalized, ''), 'name_romaji': nullif(name_romaji, ''), 'phonetic_key': nullif(phonetic_key, '')} AS c
    FROM candidates k JOIN forms USING (query_id) JOIN companies ON companies.id = k.entity_id"""
_RESOLVED = f"""{_SEARCHED}, {_POSTINGS}, {_CANDIDATES}, resolved AS MATERIALIZED (
    SELECT r.query_id, m.rank, m.entity_id, name AS entity_name, final_score AS score, best_strategy,
        CASE WHEN final_score >= 0.7 THEN 'high' WHEN final_score >= 0.4 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, cand_ord) AS rank FROM {sql.ensemble(_MEETING, 'query_id, entity_id')} JOIN candidates USING (query_id, entity_id)
          WHERE final_score >= 0.3) m
    JOIN companies ON companies.id = m.entity_id JOIN texts t ON t.query_id = m.query_id JOIN requests r ON r.text = t.t AND r.status = 'ok' WHERE m.rank <= r."limit")"""

ORACLES = {
    "collapse_ws": f"SELECT id, trim(regexp_replace(name, '{_WS}+', ' ', 'g')) AS t FROM companies",
    "normalize_name": f"SELECT c.id, name, t AS normalized FROM companies c JOIN ({sql.normalized('SELECT id, name AS t FROM companies', 'id')}) n ON c.id = n.id",
    "normalize_japanese": f"SELECT c.id, name, t AS normalized FROM companies c JOIN ({sql.normalized_japanese('SELECT id, name AS t FROM companies', 'id')}) n ON c.id = n.id",
    "normalize_english": f"SELECT c.id, en_name, t AS normalized FROM companies c JOIN ({sql.normalized_english('SELECT id, en_name AS t FROM companies', 'id')}) n ON c.id = n.id",
    "kana_romaji": f"SELECT id, {sql.romaji('furigana')} AS romaji FROM companies",
    "place_romaji": "SELECT prefecture_code, lower(pref_romaji) AS romaji FROM prefectures",
    "word_romaji": "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{r}')" for w, r in _WORDS) + ") t(w, romaji)",
    "ensemble_compare": f"""SELECT id, round(final_score, 6) AS final_score, round(jaro_winkler, 6) AS jaro_winkler, round(levenshtein, 6) AS levenshtein,
        round(token_sort, 6) AS token_sort, round(phonetic, 6) AS phonetic, best_strategy FROM {sql.ensemble(_COMPARED, 'id')}""",
    "strip_suffix_en": _EN_STRIPPED,
    "strip_suffix_ja": f"SELECT s_suppkey, t, {_sql_strip('t', text.JAPANESE_FORMS, 't')} AS stripped FROM ({_JA})",
    "removed_suffixes": f"""SELECT s_suppkey, coalesce(array_to_string(list_filter({_sql_list(text.ENGLISH_FORMS)},
        lambda f: contains(lower(t), f) AND NOT contains(lower(stripped), f)), '|'), '') AS removed FROM ({_EN_STRIPPED})""",
    "trigrams": " UNION ALL ".join(f"SELECT id AS entity_id, unnest({_GRAMS.replace('T', f)}) AS ngram, '{f}' AS source_field FROM companies WHERE {f} <> ''" for f in COMPANY.ngram_fields),
    "language_detect": f"""SELECT id, CASE WHEN regexp_replace(coalesce(name, ''), '{_WS}', '', 'g') = '' THEN 'unknown'
        WHEN regexp_matches(name, '{_JAPANESE}') THEN 'ja' WHEN regexp_matches(name, '[{text.LATIN_LETTERS}]') THEN 'en' ELSE 'unknown' END AS language,
        regexp_matches(name, '{_JAPANESE}') AS japanese, regexp_matches(name, '[{text.IDEOGRAPHS}]') AS ideograph FROM companies""",
    "script_detect": f"SELECT id, {_SCRIPT} AS script FROM (SELECT id, {_LETTERS} AS t FROM companies)",
    "phonetic_key": f"SELECT id, {_sql_key('name_romaji')} AS key FROM companies",
    "romaji_variants": """SELECT id, array_to_string(list_reduce(list_transform([name_romaji,
        replace(replace(replace(replace(replace(replace(replace(name_romaji,'ou','o'),'oo','o'),'uu','u'),'ii','i'),'ei','e'),'ee','e'),'aa','a'),
        replace(name_romaji,'ou','o'), replace(name_romaji,'oo','o'), replace(name_romaji,'uu','u'), replace(name_romaji,'ii','i'),
        replace(name_romaji,'ei','e'), replace(name_romaji,'ee','e'), replace(name_romaji,'aa','a'),
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name_romaji,'aa+$','a'),'ii+$','i'),'uu+$','u'),'ee+$','e'),'oo+$','o')],
        lambda x: [x]), lambda s, x: CASE WHEN list_contains(s, x[1]) THEN s ELSE list_concat(s, x) END), ',') AS variants
        FROM companies WHERE name_romaji <> '' UNION ALL SELECT id, '' FROM companies WHERE name_romaji = '' OR name_romaji IS NULL""",
    "sim_levenshtein": f"SELECT id, couple, round({sql.levenshtein('x', 'y')}, 6) AS score FROM ({_LOWERED})",
    "sim_jaro_winkler": f"SELECT id, couple, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round({sql.jaro_winkler('x', 'y')}, 6) END AS score FROM ({_LOWERED})",
    "sim_token_sort": f"""SELECT id, couple, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round({sql.indel('u', 'v')}, 6) END AS score
        FROM (SELECT *, {sql.sorted_words('a')} AS u, {sql.sorted_words('b')} AS v FROM ({_PAIRS}))""",
    "sim_phonetic": f"SELECT id, couple, round({sql.compared_keys('x', 'y')}, 6) AS score FROM (SELECT id, couple, {_sql_key('a')} AS x, {_sql_key('b')} AS y FROM ({_PAIRS}))",
    "ngram_index": " UNION ALL ".join(f"SELECT '{f}' AS source_field, ngram, count(*) AS n FROM (SELECT unnest({_GRAMS.replace('T', f)}) AS ngram FROM companies WHERE {f} <> '') GROUP BY ngram" for f in COMPANY.ngram_fields),
    "trigram_block_topk": f"WITH {_LOOKUP}, {_POSTINGS} {_sql_block('lookup', 'q_normalized')}",
    "phonetic_block_topk": f"WITH {_FORMS} {_PHONETIC}",
    "candidates_union": f"WITH {_FORMS}, {_POSTINGS}, {_CANDIDATES} SELECT * FROM candidates",
    "request_validation": f'SELECT query_id, "limit", status, error FROM ({_VALIDATED})',
    "query_forms": f"""WITH {_SEARCHED} SELECT query_id, language AS q_language, q_script, q_normalized, q_romaji, q_phonetic, q_variants, q_removed FROM forms
        JOIN (SELECT query_id, {_SCRIPT} AS q_script FROM (SELECT query_id, {_LETTERS.replace('name', 't')} AS t FROM texts)) USING (query_id)""",
    "resolve_topk": f"WITH {_RESOLVED} SELECT query_id, rank, entity_id, entity_name, round(score, 6) AS score, band, best_strategy FROM resolved",
    "explain_running": f"""WITH {_RESOLVED} SELECT r.query_id, r.rank, r.entity_id, len(string_split(steps, ',')) AS n_steps, steps, entity_name AS last_name
        FROM (SELECT *, 'language_detection,normalization,' || CASE WHEN f.language = 'ja' THEN 'transliteration,' ELSE '' END || 'phonetic_encoding,blocking' || repeat(',scoring', rank::INT) AS steps
        FROM resolved s JOIN requests q ON s.query_id = q.query_id JOIN texts t ON q.text = t.t JOIN forms f ON f.query_id = t.query_id) r""",
    "score_bands": f"WITH {_RESOLVED} SELECT band, count(*) AS n FROM resolved GROUP BY band",
    "sql_functions": f"""SELECT id, {sql.collapse('name')} AS spaced, coalesce(array_to_string(list_sort({_GRAMS.replace('T', 'name_normalized')}), '|'), '') AS grams, {_sql_key('name_romaji')} AS key,
        {sql.language('name')} AS language, e.score AS edits, w.score AS winkler, t.score AS tokens FROM companies
        JOIN (SELECT id AS i, couple, round({sql.levenshtein('x', 'y')}, 6) AS score FROM ({_LOWERED})) e ON id = e.i AND e.couple = 0
        JOIN (SELECT id AS i, couple, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round({sql.jaro_winkler('x', 'y')}, 6) END AS score FROM ({_LOWERED})) w ON id = w.i AND w.couple = 0
        JOIN (SELECT id AS i, couple, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round({sql.indel('u', 'v')}, 6) END AS score
              FROM (SELECT *, {sql.sorted_words('a')} AS u, {sql.sorted_words('b')} AS v FROM ({_PAIRS}))) t ON id = t.i AND t.couple = 2""",
    "dedupe_pairs": f"""WITH {_RESOLVED.replace('FROM search_requests', 'FROM (SELECT id AS query_id, name AS query_text, 50 AS max_results FROM companies WHERE id % 50 = 0)')}
        SELECT least(query_id, entity_id) AS id_a, greatest(query_id, entity_id) AS id_b, round(max(score), 6) AS score FROM resolved WHERE score >= 0.7 AND query_id <> entity_id GROUP BY ALL""",
    "unmatched_anti": f"WITH {_RESOLVED} SELECT query_id, status FROM requests WHERE query_id NOT IN (SELECT query_id FROM resolved)",
    "batch_resolve": f"""WITH {_RESOLVED} SELECT r.query_id, coalesce(m.n, 0) AS n_matches, coalesce(c.n, 0) AS total_candidates, status, error FROM requests r
        LEFT JOIN (SELECT query_id, count(*) AS n FROM resolved GROUP BY query_id) m ON r.query_id = m.query_id
        LEFT JOIN texts t ON r.text = t.t AND status = 'ok' LEFT JOIN (SELECT query_id, count(*) AS n FROM candidates GROUP BY query_id) c ON t.query_id = c.query_id""",
    "entity_projection": f"SELECT id, {', '.join(f.name for f in COMPANY.fields)} FROM companies",
    "lookup_by_ids": "SELECT id, corporate_number, name FROM companies JOIN search_requests ON id = query_id",
    "registry_stats": "SELECT (SELECT count(*) FROM companies) AS entity_count, (SELECT count(*) FROM company_ngrams) AS ngram_count",
    "ingest_first_wins": _FIRST_LINES,
    "ingest_prepared": f"""SELECT row_number() OVER (ORDER BY l.row_no) AS id, corporate_number, name, n.t AS name_normalized, furigana, en_name,
        CASE WHEN en_name IS NOT NULL THEN e.t END AS en_name_normalized, nullif(name_romaji, '') AS name_romaji, nullif({_sql_key('name_romaji')}, '') AS phonetic_key, prefecture_code, city, address
        FROM (SELECT *, {sql.romaji('name')} AS name_romaji FROM ({_FIRST_LINES})) l
        JOIN ({sql.normalized(f'SELECT row_no, name AS t FROM ({_FIRST_LINES})', 'row_no')}) n ON l.row_no = n.row_no
        JOIN ({sql.normalized(f'SELECT row_no, en_name AS t FROM ({_FIRST_LINES})', 'row_no')}) e ON l.row_no = e.row_no""",
    "ingest_ids": f"SELECT row_no, corporate_number, row_number() OVER (ORDER BY row_no) AS id FROM ({_FIRST_LINES})",
    "ingest_into_standing": f"SELECT * FROM ({_FIRST_LINES}) l WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.corporate_number = l.corporate_number)",
}
