"""The calls of the service: search, match, batch jobs, health and statistics, per entity type."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.entity_types import EntityTypeRegistry
from linkspark.operators.resolver import Resolver, compare, validated
from linkspark.settings import ResolverSettings
from linkspark.sources.registry import stats

log = logging.getLogger(__name__)
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"


def batch_results(resolver: Resolver, requests: DataFrame) -> DataFrame:
    """One row per request: ``(query_id, query, matches, total_candidates, status, error)``.

    requests: ``(query_id, query_text, max_results)``. A rejected request has status ``error`` and no matches and
    doesn't touch the others. Matches are structs ``(rank, entity_name, entity_type, entity_data, id, score)`` by rank.
    """
    checked = validated(requests, resolver.settings)
    ready = resolver.prepared(checked)
    match = F.struct("rank", "entity_name", F.lit(resolver.config.name).alias("entity_type"), "entity_data", F.col("entity_id").alias("id"), "score")
    found = resolver.matches(checked, payload=True, ready=ready).groupBy("query_id").agg(F.array_sort(F.collect_list(match)).alias("matches"))  # at most max_limit
    none = F.array().cast(found.schema["matches"].dataType)
    out = checked.join(resolver.summaries(checked, ready).select("query_id", "total_candidates"), "query_id").join(found, "query_id", "left")
    return out.select("query_id", F.col("text").alias("query"), F.coalesce("matches", none).alias("matches"), "total_candidates", "status", "error")


@dataclass
class BatchJob:
    """A job of queries; results are dicts of batch_results' columns and ``index``, in the order of the queries."""

    id: str
    queries: list[tuple[str, int | None]]
    status: str = PENDING
    completed: int = 0
    error: str | None = None
    results: list | None = None
    created_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    finished_at: datetime | None = None

    @property
    def total(self) -> int:
        return len(self.queries)


class BatchManager:
    """Jobs of one resolver, run in the background under a tag, in slices of queries that are one plan each.

    ``completed`` grows with each slice. If a plan fails, its queries are run one by one, and only those that fail
    alone have status ``error``.
    """

    def __init__(self, resolver: Resolver, slice_size: int = 25) -> None:
        self.resolver, self.slice_size, self._jobs = resolver, slice_size, {}
        self.spark: SparkSession = resolver.entities.sparkSession

    def submit(self, queries: Sequence[tuple[str, int | None]], wait: bool = False) -> BatchJob:
        if not 1 <= len(queries) <= self.resolver.settings.batch_max_queries:
            raise ValueError(f"a batch has 1 to {self.resolver.settings.batch_max_queries} queries")
        job = BatchJob(str(uuid.uuid4()), list(queries))
        self._jobs[job.id] = job
        worker = threading.Thread(target=self._run, args=(job,), daemon=True)
        worker.start()
        if wait:
            worker.join()
        return job

    def get(self, job_id: str) -> BatchJob | None:
        return self._jobs.get(job_id)

    def list(self) -> list[BatchJob]:
        return sorted(self._jobs.values(), key=lambda j: j.created_at, reverse=True)

    def _run(self, job: BatchJob) -> None:
        job.status = PROCESSING
        try:
            self.spark.addTag(job.id)
            rows = [(i, q, n) for i, (q, n) in enumerate(job.queries)]
            job.results = []
            for at in range(0, len(rows), self.slice_size):
                job.results += self._answers(rows[at : at + self.slice_size])
                job.completed = len(job.results)
            job.status = COMPLETED
        except Exception as e:  # noqa: BLE001
            log.exception("batch %s failed", job.id)
            job.status, job.error = FAILED, str(e)
        finally:
            self.spark.removeTag(job.id)
            job.finished_at = datetime.now(UTC)


    def _answers(self, rows: list[tuple]) -> list[dict]:
        try:
            requests = self.spark.createDataFrame(rows, "query_id bigint, query_text string, max_results int")
            found = batch_results(self.resolver, requests).orderBy("query_id").collect()  # at most slice_size rows
            return [{"index": x["query_id"], **x.asDict(recursive=True)} for x in found]
        except Exception as e:  # noqa: BLE001
            log.warning("batch slice failed: %s", e)
            if len(rows) > 1:
                return [x for row in rows for x in self._answers([row])]
            (i, query, _), = rows
            return [{"index": i, "query_id": i, "query": query, "matches": [], "total_candidates": 0, "status": "error", "error": str(e)}]


class Service:
    """Entity types with their tables, and the calls on them."""

    def __init__(self, spark: SparkSession, types: EntityTypeRegistry | None = None, settings: ResolverSettings | None = None) -> None:
        self.spark, self.types = spark, types or EntityTypeRegistry.default()
        self.settings = settings or ResolverSettings.from_session(spark)
        self._resolvers: dict[str, Resolver] = {}
        self._batches: dict[str, BatchManager] = {}

    def attach(self, entity_type: str, entities: DataFrame, ngrams: DataFrame) -> Resolver:
        """Gives an entity type its tables."""
        self._resolvers[entity_type] = Resolver(entities, ngrams, self.types.get(entity_type), self.settings)
        return self._resolvers[entity_type]

    def resolver(self, entity_type: str = "company") -> Resolver:
        self.types.get(entity_type)
        if entity_type not in self._resolvers:
            raise KeyError(f"no tables attached for {entity_type!r}")
        return self._resolvers[entity_type]

    def search(self, query: str, limit: int | None = None, entity_type: str = "company") -> dict:
        """The matches of one query, with explanations."""
        began, r = time.time(), self.resolver(entity_type)
        checked = validated(self.spark.createDataFrame([(0, query, limit)], "query_id bigint, query_text string, max_results int"), r.settings)
        if (error := checked.first()["error"]) is not None:
            raise ValueError(error)
        ready = r.prepared(checked)
        summary = r.summaries(checked, ready).first()
        found = r.matches(checked, payload=True, explain=True, ready=ready).orderBy("rank").collect()  # at most max_limit rows
        steps = [x.asDict() for x in (found[-1]["explanations"] if found else summary["processing_steps"])]
        return {
            "query": query, "entity_type": entity_type, "detected_language": summary["detected_language"], "query_forms": summary["query_forms"],
            "total_candidates": summary["total_candidates"], "matches": [{"entity_type": entity_type, **x.asDict(recursive=True)} for x in found], "processing_steps": steps,
            "processing_time_ms": round(1000 * (time.time() - began), 2),
        }

    def match(self, name_a: str, name_b: str, entity_type: str = "company") -> dict:
        """The comparison of two names."""
        for n in (name_a, name_b):
            if not n or len(n) > self.settings.max_query_length:
                raise ValueError("a name has 1 to %d characters" % self.settings.max_query_length)
        pair = self.spark.createDataFrame([(name_a, name_b)], "name_a string, name_b string")
        out = compare(pair, config=self.types.get(entity_type)).first().asDict(recursive=True)
        told = [{"step": f"normalization_{side}", "description": f"Normalized forms for '{name}'", "details": out[f"forms_{side}"]} for side, name in (("a", name_a), ("b", name_b))]
        return {**out, "explanation": told}

    def submit_batch(self, queries: Sequence[tuple[str, int | None]], entity_type: str = "company", wait: bool = False) -> BatchJob:
        return self._batches.setdefault(entity_type, BatchManager(self.resolver(entity_type))).submit(queries, wait)

    def batch_status(self, job_id: str, entity_type: str = "company") -> BatchJob | None:
        manager = self._batches.get(entity_type)
        return manager.get(job_id) if manager else None

    def health(self) -> dict:
        return {"status": "healthy"}

    def stats(self) -> dict:
        row = stats({n: (r.entities, r.ngrams) for n, r in self._resolvers.items()}).first()
        return {**row.asDict(), "entity_types": self.types.names()}
