"""Limits and thresholds of a resolver."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ResolverSettings:
    """Values that a session may override as ``linkspark.<field>`` in its configuration."""

    trigram_candidate_limit: int = 200
    phonetic_candidate_limit: int = 100
    min_score_threshold: float = 0.3
    phonetic_prefix: int = 4
    default_limit: int = 10
    max_limit: int = 50
    max_query_length: int = 200
    batch_max_queries: int = 100

    @classmethod
    def from_session(cls, spark: SparkSession) -> ResolverSettings:
        """``linkspark.<field>`` of the session, else ``LINKSPARK_<FIELD>`` of the environment, else the defaults."""
        found = {f.name: spark.conf.get(f"linkspark.{f.name}", os.environ.get(f"LINKSPARK_{f.name.upper()}")) for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in found.items() if v is not None})
