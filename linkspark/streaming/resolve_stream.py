"""Queries that arrive as a stream, resolved against a registry that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkspark.operators.resolver import Resolver, validated


def resolve_stream(requests: DataFrame, resolver: Resolver, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the matches of each micro-batch as parquet under ``out``, once per batch id.

    The ranking windows need a finite set of queries, so that each micro-batch is resolved as one by foreachBatch. A
    batch that is repeated after a failure overwrites its own folder.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        matches = resolver.matches(validated(batch, resolver.settings))
        matches.drop("strategy_results").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
