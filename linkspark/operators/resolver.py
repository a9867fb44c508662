"""Search: every query against every entity, in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.text import strip
from linkspark.operators.blocking import candidates
from linkspark.operators.ensemble import Ensemble
from linkspark.operators.entity_types import COMPANY, EntityTypeConfig
from linkspark.operators.explain import STEP, blocking_step, query_steps, scoring_step
from linkspark.operators.forms import FORMS, with_query_forms
from linkspark.settings import ResolverSettings
from linkspark.sources.tables import cut


#: Prepared texts that are broadcast at most; more of them meet their pairs by exchange.
MOST_BROADCAST_TEXTS = 50_000


def validated(requests: DataFrame, settings: ResolverSettings, query_id: str = "query_id", text: str = "query_text", limit: str | None = "max_results") -> DataFrame:
    """``(query_id, text, limit, status, error)``: rejected requests keep their row, with the reason.

    A text must have 1 to max_query_length characters (blanks alone are some), a limit lies between 1 and max_limit; a
    missing limit is the default.
    """
    wanted = F.coalesce(F.col(limit).cast("int"), F.lit(settings.default_limit)) if limit else F.lit(settings.default_limit)
    n = F.length(F.col(text))
    error = (
        F.when(F.col(text).isNull() | (n < 1), "query is missing")
        .when(n > settings.max_query_length, "query is too long")
        .when((wanted < 1) | (wanted > settings.max_limit), "limit is out of range")
    )
    out = requests.select(F.col(query_id).alias("query_id"), F.col(text).alias("text"), wanted.alias("limit"), error.alias("error"))
    return out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def band(score) -> F.Column:
    """Confidence of a score."""
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


@dataclass(frozen=True)
class Prepared:
    """What searches of the same requests share."""

    forms: DataFrame
    candidates: DataFrame


@dataclass
class Resolver:
    """Resolves queries against a registry and its n-gram index ``(entity_id, ngram, ...)``."""

    entities: DataFrame
    ngrams: DataFrame
    config: EntityTypeConfig = COMPANY
    settings: ResolverSettings = field(default_factory=ResolverSettings)
    ensemble: Ensemble | None = None
    lexicon: dict[str, str] | None = None
    #: Whether the index may hold a posting more than once.
    repeated_postings: bool = False

    def __post_init__(self) -> None:
        self.ensemble = self.ensemble or Ensemble(text_pairs=self.config.text_pairs, phonetic_pairs=self.config.phonetic_pairs)

    def query_forms(self, requests: DataFrame) -> DataFrame:
        """Distinct texts of valid requests with their forms; a text's id is the smallest of its requests."""
        texts = requests.where("status = 'ok'").groupBy("text").agg(F.min("query_id").alias("query_id"))
        # written once: every channel, the scores and the explanations read them
        return cut(with_query_forms(texts, "text", self.config, lexicon=self.lexicon))

    def prepared(self, requests: DataFrame) -> Prepared:
        """Forms and candidates of validated requests, each written once, for matches() and summaries() of the same requests."""
        forms = self.query_forms(requests)
        return Prepared(forms, cut(self.candidates(forms)))

    def candidates(self, forms: DataFrame) -> DataFrame:
        """The candidates of blocking for query_forms()."""
        return candidates(forms, self.entities, self.ngrams, self.settings, bool(self.config.phonetic_pairs), self.repeated_postings)

    def _meet(self, pairs: DataFrame, forms: DataFrame) -> DataFrame:
        """Pairs of ``query_id`` and ``entity_id`` with both sides' prepared texts; only compared columns of the registry are read."""
        stored = self.ensemble.prepare(self.entities, self.config.candidate_forms(), "c")
        asked = self.ensemble.prepare(forms, {f: F.col(f"q_{f}") for f in FORMS}, "q")
        kinds = {s.prepared_as or s.name for s in self.ensemble.registry.all()}
        mine = lambda df, side: [c for c in df.columns if any(c.startswith(f"{side}_{k}_") for k in kinds)]
        spark = pairs.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        stored, asked = stored.select(F.col("id").alias("entity_id"), *mine(stored, "c")), asked.select("query_id", *mine(asked, "q"))
        # scoring costs computation, so its tasks are many even where the pairs' bytes are few
        if forms.count() > MOST_BROADCAST_TEXTS:
            return pairs.repartition(tasks, "query_id", "entity_id").join(stored, "entity_id").join(asked, "query_id")
        # the texts go to the pairs, so that no pair is moved with its texts
        return pairs.repartition(tasks, "entity_id").join(stored.repartition(tasks, "entity_id"), "entity_id").join(F.broadcast(asked), "query_id")

    def scored(self, ready: Prepared) -> DataFrame:
        """``(query_id, entity_id, cand_ord, n_trigram, n_phonetic, final_score)`` of every candidate."""
        return self.ensemble.score(self._meet(ready.candidates, ready.forms)).select("query_id", "entity_id", "cand_ord", "n_trigram", "n_phonetic", "final_score")

    def ranked(self, ready: Prepared) -> DataFrame:
        """``scored`` with ``rank``, by score and then by the order of blocking, up to the largest limit and from the threshold on.

        The threshold comes after the ranks, which it doesn't change: before them, the optimiser would put all that the
        score consists of into the filter as well, and every similarity would be computed twice.
        """
        best = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "cand_ord")
        ranked = self.scored(ready).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.settings.max_limit)
        return ranked.where(F.col("final_score") >= self.settings.min_score_threshold)

    def matches(self, requests: DataFrame, payload: bool = False, explain: bool = False, ready: Prepared | None = None) -> DataFrame:
        """``(query_id, rank, entity_id, entity_name, score, band, best_strategy, strategy_results, ...)`` of validated requests.

        Candidates below the threshold are left out, the others are ranked by score and then by the order of blocking,
        up to each request's own limit. payload adds the entity as ``entity_data``, read for kept matches only; explain
        adds ``explanations``, the steps up to that match.
        """
        ready = ready or self.prepared(requests)
        forms = ready.forms
        # requests with the same text share its matches
        owners = forms.select(F.col("query_id").alias("text_id"), "text")
        asked = requests.where("status = 'ok'").select("query_id", "text", "limit").join(owners, "text").drop("text")
        largest = asked.groupBy(F.col("text_id").alias("query_id")).agg(F.max("limit").alias("largest"))
        kept = self.ranked(ready)
        # the breakdown is made for kept matches only
        kept = cut(kept.select("query_id", "entity_id", "rank").join(largest, "query_id").where("rank <= largest").drop("largest"))
        kept = self.ensemble.explain(self.ensemble.score(self._meet(kept, forms))).select("query_id", "entity_id", "rank", "result")
        fields = [F.col("id").alias("entity_id"), F.col(self.config.display_field).alias("entity_name")]
        if payload:
            fields.append(F.struct(*[f.name for f in self.config.fields]).alias("entity_data"))
        kept = kept.join(self.entities.select(*fields), "entity_id")
        out = asked.join(kept.withColumnRenamed("query_id", "text_id"), "text_id").where(F.col("rank") <= F.col("limit"))
        if explain:
            steps = self._steps(ready).select("text_id", "steps")
            running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            out = out.withColumn("one", scoring_step(F.col("entity_name"), F.col("result.final_score"), F.col("result.strategy_results")))
            out = out.withColumn("upto", F.collect_list("one").over(running)).join(steps, "text_id").withColumn("explanations", F.concat("steps", "upto"))
        score = F.col("result.final_score")
        return out.select(
            "query_id", "rank", "entity_id", "entity_name", score.alias("score"), band(score).alias("band"), F.col("result.best_strategy").alias("best_strategy"),
            F.col("result.strategy_results").alias("strategy_results"), F.col("result.query_forms_used").alias("query_forms_used"),
            F.col("result.candidate_forms_used").alias("candidate_forms_used"), *(["entity_data"] if payload else []), *(["explanations"] if explain else []),
        )

    def _steps(self, ready: Prepared) -> DataFrame:
        """``(text_id, text, language, forms, total, steps)``: what is known of a text before its candidates are scored."""
        totals = ready.candidates.groupBy("query_id").agg(F.count("*").alias("total"), F.max("n_trigram").alias("nt"), F.max("n_phonetic").alias("np"))
        each = ready.forms.join(totals, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "nt", "np")}).withColumn("steps", query_steps())
        ja = F.col("q_language") == "ja"
        shown = F.create_map(*[x for f in ("original", "language", "normalized", "romaji", "phonetic") for x in (F.lit(f), F.col(f"q_{f}"))])
        shown = F.when(ja, F.map_concat(shown, F.create_map(F.lit("variants"), F.array_join("q_variants", ",")))).otherwise(shown)
        steps = F.concat("steps", F.array(blocking_step(F.col("total"), F.col("nt"), F.col("np"))))
        return each.select(F.col("query_id").alias("text_id"), "text", F.col("q_language").alias("language"), shown.alias("forms"), "total", steps.alias("steps"))

    def summaries(self, requests: DataFrame, ready: Prepared | None = None) -> DataFrame:
        """``(query_id, detected_language, query_forms, total_candidates, processing_steps, status, error)`` of every request.

        Rejected requests have language ``unknown``, no forms and no steps; requests without matches have theirs.
        """
        per_text = self._steps(ready or self.prepared(requests)).drop("text_id")
        out = requests.join(per_text, "text", "left")
        return out.select(
            "query_id", F.coalesce("language", F.lit("unknown")).alias("detected_language"), F.coalesce("forms", F.create_map().cast("map<string,string>")).alias("query_forms"),
            F.coalesce("total", F.lit(0)).alias("total_candidates"), F.coalesce("steps", F.array().cast(f"array<{STEP}>")).alias("processing_steps"), "status", "error",
        )


def compare(pairs: DataFrame, a: str = "name_a", b: str = "name_b", config: EntityTypeConfig = COMPANY, ensemble: Ensemble | None = None, lexicon: dict[str, str] | None = None) -> DataFrame:
    """``pairs`` with ``final_score``, ``strategy_results``, ``best_strategy`` and both sides' forms; no registry, no threshold.

    The first name also counts in its original form, the second doesn't. A null name counts as ''.
    """
    ensemble = ensemble or Ensemble(text_pairs=config.text_pairs, phonetic_pairs=config.phonetic_pairs)
    formed = with_query_forms(with_query_forms(pairs, a, config, "a_", lexicon), b, config, "b_", lexicon)
    formed = ensemble.prepare(formed, {f: F.col(f"a_{f}") for f in FORMS}, "q")
    formed = ensemble.prepare(formed, config.as_candidate({f: F.col(f"b_{f}") for f in FORMS}), "c")
    staged = ensemble.explain(ensemble.score(formed))
    forms = [F.struct(*[F.col(f"{p}{f}").alias(f) for f in ("original", "language", "normalized", "romaji", "phonetic")]).alias(f"forms_{p[0]}") for p in ("a_", "b_")]
    return staged.select(*[F.col(f"`{c}`") for c in pairs.columns], "result.final_score", "result.strategy_results", "result.best_strategy", *forms)


def dedupe_pairs(resolver: Resolver, of: DataFrame, least: float = 0.9) -> DataFrame:
    """``(id_a, id_b, score)``: pairs of different entities, one of them in ``of``, that a search for its name brings together.

    Each name is searched like a request with the largest limit; a pair found from both sides has its better score.
    Names that are no valid request find nothing.
    """
    names = of.select(F.col("id").alias("query_id"), F.col(resolver.config.display_field).alias("query_text"), F.lit(resolver.settings.max_limit).alias("max_results"))
    found = resolver.matches(validated(names, resolver.settings)).where((F.col("score") >= least) & (F.col("query_id") != F.col("entity_id")))
    return found.groupBy(F.least("query_id", "entity_id").alias("id_a"), F.greatest("query_id", "entity_id").alias("id_b")).agg(F.max("score").alias("score"))


def unmatched(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """Requests without any match."""
    return requests.join(matches.select("query_id").distinct(), "query_id", "left_anti")


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither null nor white space."""
    return df.where(F.col(column).isNotNull() & (strip(F.col(column)) != ""))
