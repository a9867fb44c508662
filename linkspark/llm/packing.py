"""Filling containers of fixed capacity with the token sequences of documents (problem 7).

Sum-of-squares online packing: N(h) is the number of open containers filled up to level h. An item goes to the level,
or to a new container, after which the sum of N(h)^2 over the partly filled levels is smallest; equal choices go to the
fullest. N is a level array, so a step looks at the levels, never at containers.

Documents are dealt by a hash of their id into shards of about ``SHARD_DOCS``, whose number follows the table. A task
streams its shards in the order of the hash and keeps only the level array and the open containers of the shard it is
in. What a shard leaves open is few, and is packed once more: the partly filled containers of ``SHARD_GROUP`` shards
are the items of a second run by the same rule, which moves them whole into each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tokenizer import VOCABULARY, count_tokens
from linkspark.sources.tables import cut

CAPACITY = 2048
SHARD_DOCS = 8192
SHARD_GROUP = 256


class SumOfSquares:
    """The level array and the open containers by level."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The container and the offset in it for an item of 1..capacity."""
        n, c = self.levels, self.capacity
        here, there = n[: c - size + 1], n[size : c + 1]
        # leaving level h takes 2 N(h) - 1 from the sum, arriving at h + size adds 2 N(h + size) + 1
        change = np.where(here > 0, 1 - 2 * here, 1 << 40)
        change[0] = 0
        change[:-1] += 2 * there[:-1] + 1  # a full container isn't counted
        level = c - size - int(np.argmin(change[::-1]))
        if level:
            container = self.open[level].pop()
            n[level] -= 1
        else:
            container, self.made = self.made, self.made + 1
        if (to := level + size) < c:
            self.open.setdefault(to, []).append(container)
            n[to] += 1
        return container, level


def _pack_stream(capacity: int, names: list[str]):
    """Packs a stream of (shard, key, size) sorted by shard; gives (shard, key, container, level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None
        for batch in batches:
            s, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            where = []
            for x, size in zip(s, sizes):
                if x != shard or state is None:
                    shard, state = x, SumOfSquares(capacity)
                where.append(state.place(size))
            c = pa.array([w[0] for w in where], pa.int64())
            o = pa.array([w[1] for w in where], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), c, o], names)

    return run


def pack(sizes: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", capacity: int = CAPACITY, tasks: int | None = None) -> DataFrame:
    """``(<id_column>, part, n_parts, shard, container, start, length)``: where every part of an item lies.

    ``(shard, container)`` names a container. Defined cases: an item above the capacity is split into parts that fill
    containers of their own and one rest; no other item is split. An item of size 0 or null takes no room and has one
    row with null shard, container and start. Repeated ids are packed each. The result doesn't depend on how the
    table is partitioned. tasks: among how many the shards are dealt, by default one for each shard.
    """
    size = F.coalesce(F.col(size_column), F.lit(0)).cast("long")
    items = sizes.select(F.col(id_column).alias("k"), size.alias("n"))
    items = cut(items)  # counted, then packed
    docs = items.count()
    shards = max(1, -(-docs // SHARD_DOCS))
    whole = F.floor(F.col("n") / capacity)
    rest = F.col("n") - whole * capacity
    parts = F.greatest(F.lit(1), whole + (rest > 0).cast("long"))
    # a hash of the id alone: hot ids can't crowd a shard, as repeats of an id are separate items of any order
    h = F.xxhash64("k")
    placed = items.select("k", "n", whole.alias("whole"), rest.alias("rest"), parts.alias("n_parts"), h.alias("h"))
    placed = placed.withColumn("shard", F.pmod("h", F.lit(shards)).cast("long"))

    streamed = placed.where("rest > 0").select("shard", F.struct("k", "n_parts", "whole").alias("key"), F.col("rest").alias("size"), "h")
    streamed = streamed.repartition(tasks or shards, "shard").sortWithinPartitions("shard", "h", "size")
    kind = sizes.schema[id_column].dataType.simpleString()
    first = cut(
        streamed.select("shard", F.struct("key", "size").alias("key"), "size").mapInArrow(
            _pack_stream(capacity, ["shard", "key", "container", "start"]),
            f"shard bigint, key struct<key:struct<k:{kind},n_parts:bigint,whole:bigint>,size:bigint>, container bigint, start bigint",
        )
    )
    # the partly filled containers of a group of shards are packed once more
    fill = first.groupBy("shard", "container").agg(F.sum("key.size").alias("size")).where(F.col("size") < capacity)
    again = fill.select((F.col("shard") / SHARD_GROUP).cast("long").alias("g"), F.struct("shard", "container").alias("key"), "size")
    again = again.repartition("g").sortWithinPartitions("g", F.desc("size"), "key")
    moved = again.mapInArrow(
        _pack_stream(capacity, ["g", "key", "into", "shift"]),
        "g bigint, key struct<shard:bigint,container:bigint>, into bigint, shift bigint",
    ).select(F.col("key.shard").alias("shard"), F.col("key.container").alias("container"), "g", "into", "shift")
    rests = first.join(moved, ["shard", "container"], "left").select(
        F.col("key.key.k").alias("k"),
        (F.col("key.key.whole") + 1).alias("part"),
        F.col("key.key.n_parts").alias("n_parts"),
        # merged containers are numbered below zero, by group
        F.coalesce(-1 - F.col("g"), F.col("shard")).alias("shard"),
        F.coalesce("into", "container").alias("container"),
        (F.col("start") + F.coalesce("shift", F.lit(0))).alias("start"),
        F.col("key.size").alias("length"),
    )
    # full parts stand alone: their container is named by a hash of the item and the part
    full = placed.where("whole > 0").select("k", "n_parts", "n", F.explode(F.sequence(F.lit(1).cast("long"), "whole")).alias("part"))
    full = full.select("k", "part", "n_parts", F.lit(None).cast("long").alias("shard"), F.xxhash64("k", "part").alias("container"), F.lit(0).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"))
    none = F.lit(None).cast("long")
    empty = placed.where("n <= 0").select("k", F.lit(1).cast("long").alias("part"), "n_parts", none.alias("shard"), none.alias("container"), none.alias("start"), F.lit(0).cast("long").alias("length"))
    return rests.unionByName(full).unionByName(empty).withColumnRenamed("k", id_column)


def pack_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack() of the texts, measured in tokens of the vocabulary."""
    return pack(count_tokens(df, id_column, text_column, vocabulary), id_column, "n_tokens", capacity)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(n_containers, n_tokens, unused)`` over all containers; zeros for an empty table."""
    per = packed.where(F.col("container").isNotNull()).groupBy("shard", "container").agg(F.sum("length").alias("used"), F.max(F.col("start") + F.col("length")).alias("upto"))
    tokens = F.coalesce(F.sum("used"), F.lit(0))
    return per.agg(F.count("*").alias("n_containers"), tokens.alias("n_tokens"), (F.count("*") * capacity - tokens).alias("unused"), F.coalesce(F.max("upto"), F.lit(0)).alias("fullest"))


def packing_faults(packed: DataFrame, id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``(n_items, n_overfull, n_overlapping, n_split_early, n_broken)`` of a packing: items, and what no packing may have.

    Containers filled above the capacity, parts that begin before the one below them ends, items split that would fit,
    and items whose parts aren't all there. Repeated ids count as one item here and must agree in all of this.
    """
    part = Window.partitionBy("shard", "container").orderBy("start", "length")
    placed = packed.where(F.col("container").isNotNull())
    over = placed.withColumn("gap", F.col("start") - F.lag(F.col("start") + F.col("length"), 1, 0).over(part))
    full = over.groupBy("shard", "container").agg(F.sum("length").alias("used"), F.min("gap").alias("gap"), F.max(F.col("start") + F.col("length")).alias("upto"))
    containers_ = full.agg(F.count_if((F.col("used") > capacity) | (F.col("upto") > capacity)).alias("n_overfull"), F.count_if(F.col("gap") < 0).alias("n_overlapping"))
    items = packed.groupBy(id_column).agg(F.count("*").alias("n"), F.max("n_parts").alias("parts"), F.sum("length").alias("size"), F.count_distinct("part").alias("kinds"))
    split = (F.col("parts") > 1) & (F.col("size") <= capacity)
    totals = items.agg(F.count("*").alias("n_items"), F.count_if(split).alias("n_split_early"), F.count_if((F.col("kinds") != F.col("parts")) | (F.col("n") % F.col("parts") != 0)).alias("n_broken"))
    return totals.crossJoin(containers_).select("n_items", "n_overfull", "n_overlapping", "n_split_early", "n_broken")  # one row each
