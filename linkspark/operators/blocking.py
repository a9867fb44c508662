"""Candidates of queries, by shared trigrams and by phonetic prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.text import trigrams
from linkspark.operators.overlap import best_by_overlap, coded_grams
from linkspark.settings import ResolverSettings
from linkspark.sources.tables import cut


def ngram_index(entities: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """``(entity_id, ngram, source_field)``: the set of trigrams of each field that is neither null nor empty."""
    texts = F.array(*[F.struct(F.lit(f).alias("source_field"), F.col(f).alias("text")) for f in fields])
    rows = entities.select(F.col(key).alias("entity_id"), F.inline(texts)).where("text <> ''")
    return rows.select("entity_id", F.explode(trigrams(F.col("text"))).alias("ngram"), "source_field")


#: Rows of query grams that are broadcast at most; more of them meet the index in salted buckets.
MOST_BROADCAST_GRAMS = 1_000_000
#: From so many texts on, counts are made by kernels over blocks of entities and texts, as their pairs outnumber the index.
MANY_TEXTS = 64
#: Buckets of entities among which the postings of a gram are spread where the queries are too many to broadcast.
BUCKETS = 64


def _meeting(postings: DataFrame, grams: DataFrame, n_grams: int) -> DataFrame:
    """``postings`` with the columns of ``grams`` that have their ngram; no task depends on how often a gram occurs.

    A few grams hold most postings, so that a join partitioned by gram would hang on them. Up to MOST_BROADCAST_GRAMS
    the grams go to the postings. Beyond, every gram is split into buckets of entities.
    """
    if n_grams <= MOST_BROADCAST_GRAMS:
        return postings.join(F.broadcast(grams), "ngram")
    salted = grams.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return postings.withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).cast("int")).join(salted, ["ngram", "bucket"])


def _most_shared(wanted: DataFrame, n_texts: int, n_grams: int, ngrams: DataFrame, by: list[str], limit: int, repeated: bool) -> DataFrame:
    """``(<by>, entity_id, match_count, rank)`` of ``wanted (<by>, ngram)``, up to ``limit`` for each of ``by``.

    The pairs of few texts are counted by Spark. Those of many would outnumber all else that is moved, so that they are
    counted in arrays and only the best leave a task.
    """
    postings = ngrams.select("entity_id", "ngram", *(["source_field"] if repeated else []))
    once = (lambda df: df.distinct()) if repeated else (lambda df: df)
    best = Window.partitionBy(*by).orderBy(F.desc("match_count"), "entity_id")
    if n_texts < MANY_TEXTS:
        if n_grams <= MOST_BROADCAST_GRAMS:
            postings = postings.join(F.broadcast(wanted.select("ngram").distinct()), "ngram", "left_semi")
        counts = _meeting(once(postings), wanted, n_grams).groupBy(*by, "entity_id").agg(F.count("*").alias("match_count"))
    else:
        spark = ngrams.sparkSession
        coded = cut(coded_grams(wanted))
        n_coded = coded.count()
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        met = once(_meeting(postings, coded, n_coded).drop("ngram", "bucket").repartition(tasks, "entity_id"))
        entities = met.groupBy("entity_id").agg(F.collect_list("g").alias("gs"))  # as many as an entity has postings
        texts = wanted.join(F.broadcast(coded) if n_coded <= MOST_BROADCAST_GRAMS else coded, "ngram").groupBy(*by).agg(F.collect_list("g").alias("gs"))
        counts, whole = best_by_overlap(texts, entities, by, limit, n_texts)
        if whole:
            return counts
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def trigram_blocks(queries: DataFrame, texts: dict[int, str], ngrams: DataFrame, limit: int, query_id: str = "query_id", repeated: bool = False) -> DataFrame:
    """``(query_id, channel, entity_id, match_count, rank)``: for each channel's text column the entities that share most postings.

    match_count counts postings, so an entity scores once for every field. Ties at the limit go to the smaller id. A
    text that is null or empty has no entities. All channels are answered by one pass over the index. repeated: postings
    ``(entity_id, ngram, source_field)`` may stand in the index more than once and count once.
    """
    asked = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(t).alias("t")) for c, t in texts.items()]))
    wanted = queries.select(F.col(query_id).alias("query_id"), asked).where("t <> ''").select("query_id", "channel", F.explode(trigrams(F.col("t"))).alias("ngram"))
    size = wanted.agg(F.count_distinct("query_id", "channel").alias("texts"), F.count("*").alias("grams")).first()
    best = _most_shared(wanted, size["texts"], size["grams"], ngrams, ["query_id", "channel"], limit, repeated)
    return best.select("query_id", "channel", "entity_id", "match_count", "rank")


def trigram_block(queries: DataFrame, text: str, ngrams: DataFrame, limit: int, query_id: str = "query_id", repeated: bool = False) -> DataFrame:
    """``(query_id, entity_id, match_count, rank)``: trigram_blocks of one text column."""
    return trigram_blocks(queries, {1: text}, ngrams, limit, query_id, repeated).drop("channel")


def phonetic_block(queries: DataFrame, key: str, entities: DataFrame, limit: int, prefix: int = 4, query_id: str = "query_id", entity_id: str = "id", entity_key: str = "phonetic_key") -> DataFrame:
    """``(query_id, entity_id, rank)``: the first entities by id whose key begins as the query's does."""
    wanted = queries.where(F.col(key) != "").select(F.col(query_id).alias("query_id"), F.substring(key, 1, prefix).alias("p"))
    # only the first ones of a prefix can be anyone's candidates
    first = Window.partitionBy("p").orderBy("entity_id")
    there = entities.where(F.col(entity_key) != "").select(F.col(entity_id).alias("entity_id"), F.substring(entity_key, 1, prefix).alias("p"))
    there = there.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)
    return wanted.join(there, "p").select("query_id", "entity_id", "rank")


def candidates(queries: DataFrame, entities: DataFrame, ngrams: DataFrame, settings: ResolverSettings, phonetic: bool = True, repeated: bool = False) -> DataFrame:
    """``(query_id, entity_id, channel, channel_rank, cand_ord, n_trigram, n_phonetic)``: the channels' union, each entity once where it is seen first.

    Channels: trigrams of the normalised form, trigrams of the romanised form where that is another one, phonetic
    prefix. queries: ``query_id, q_normalized, q_romaji, q_phonetic``.
    """
    other = queries.withColumn("q_romaji", F.when(F.col("q_romaji") != F.col("q_normalized"), F.col("q_romaji")))
    seen = trigram_blocks(other, {1: "q_normalized", 2: "q_romaji"}, ngrams, settings.trigram_candidate_limit, repeated=repeated).select("query_id", "entity_id", "channel", "rank")
    if phonetic:
        seen = seen.unionByName(phonetic_block(queries, "q_phonetic", entities, settings.phonetic_candidate_limit, settings.phonetic_prefix).select("query_id", "entity_id", F.lit(3).alias("channel"), "rank"))
    first = seen.groupBy("query_id", "entity_id").agg(
        F.min(F.struct("channel", "rank")).alias("f"), F.max((F.col("channel") < 3).cast("int")).alias("t"), F.max((F.col("channel") == 3).cast("int")).alias("p")
    )
    order = Window.partitionBy("query_id").orderBy("f.channel", "f.rank")
    whole = Window.partitionBy("query_id")
    return first.select(
        "query_id", "entity_id", F.col("f.channel").alias("channel"), F.col("f.rank").alias("channel_rank"), F.row_number().over(order).alias("cand_ord"),
        F.sum("t").over(whole).alias("n_trigram"), F.sum("p").over(whole).alias("n_phonetic"),
    )
