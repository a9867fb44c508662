"""Shared grams of many texts and many entities, counted by array kernels over a grid of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.sources.tables import cut

#: Postings that a task holds at most, but for the last entity's.
BLOCK_POSTINGS = 8_000_000
#: A gram that more than one in so many entities of a block have is held as a row of counts, other ones as a list.
DENSE = 8
#: Texts whose results are given out at once.
AT_ONCE = 512


def coded_grams(wanted: DataFrame) -> DataFrame:
    """``(ngram, g)``: the distinct grams, numbered from 0."""
    numbered = cut(wanted.select("ngram").distinct()).select("ngram", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"))
    sizes = numbered.groupBy("part").agg(F.min("i").alias("i"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    shifts, seen = [], 0
    for r in sizes:
        shifts.append(F.when(F.col("part") == r["part"], F.lit(seen - r["i"])))
        seen += r["n"]
    return numbered.select("ngram", (F.col("i") + F.coalesce(*shifts, F.lit(0))).cast("int").alias("g"))


def best_by_overlap(texts: DataFrame, entities: DataFrame, by: list[str], limit: int, n_texts: int) -> tuple[DataFrame, bool]:
    """``(<by>, entity_id, match_count, rank)``: of each text the entities of every block that share most grams, and whether there is one block only.

    texts: ``(<by>, gs)``; entities: ``(entity_id, gs)``, both with an array of numbered grams, where an entity's gram
    stands once for each field. Every block of entities meets every block of texts in one task.
    """
    spark = texts.sparkSession
    entities = cut(entities)
    n = entities.agg(F.sum(F.size("gs"))).first()[0] or 0
    blocks = max(1, -(-n // BLOCK_POSTINGS))
    parts = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // blocks), n_texts))
    kinds = {f.name: f.dataType.simpleString() for f in [*texts.schema.fields, *entities.schema.fields]}
    place = lambda e, q: (e * F.lit(parts) + q).cast("int").alias("place")
    mine = entities.withColumn("e", F.pmod(F.xxhash64("entity_id"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    mine = mine.select(place(F.col("e"), F.col("q")), *[F.lit(None).cast(kinds[c]).alias(c) for c in by], "entity_id", "gs", F.lit(True).alias("stored"))
    asked = texts.withColumn("q", F.pmod(F.xxhash64(*by), F.lit(parts))).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select(place(F.col("e"), F.col("q")), *by, F.lit(None).cast(kinds["entity_id"]).alias("entity_id"), "gs", F.lit(False).alias("stored"))
    laid = mine.unionByName(asked).repartitionById(blocks * parts, F.col("place")).drop("place")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "entity_id"]) + ", match_count bigint, rank int"
    return laid.mapInArrow(_kernel(by, limit), schema), blocks == 1


def _flat(lists: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the length of each."""
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    return np.concatenate(values or [np.empty(0, "int32")]), np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists] or [np.empty(0, "int32")])


def _kernel(by: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grams, keys, asked = [], [], [], []
        for b in batches:
            for stored, kept in ((True, ids), (False, keys)):
                if (rows := b.filter(pc.equal(b.column("stored"), stored))).num_rows:
                    kept.append(rows.column("entity_id") if stored else rows.select(by))
                    (grams if stored else asked).append(rows.column("gs"))
        if not ids or not keys:
            return
        ids, keys = pa.concat_arrays(ids), pa.Table.from_batches(keys).combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_start")
        ids = ids.take(order)
        rank = np.empty(len(ids), "int64")
        rank[order.to_numpy()] = np.arange(len(ids))
        wanted, lengths = _flat(asked)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        known, wanted = np.unique(wanted, return_inverse=True)
        rows, lists = _index(rank, grams, known)
        del grams
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in range(len(lengths)):
            at, count = _best(wanted[ends[i] : ends[i + 1]], rows, lists, len(ids), limit)
            found.append((i, at, count))
            if len(found) == AT_ONCE or i + 1 == len(lengths):
                yield _told(found, keys, ids, by)
                found = []

    return run


def _index(rank: np.ndarray, grams: list[pa.Array], known: np.ndarray) -> tuple[dict[int, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Of each known gram the places of its entities and their counts, and of those that many entities have a row of counts."""
    n = len(rank)
    values, lengths = _flat(grams)
    where = np.searchsorted(known, values)
    there = known[np.minimum(where, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)
    pairs = (where * n + np.repeat(rank, lengths))[there]
    del values, where, there
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    starts = np.searchsorted(pairs, np.arange(len(known) + 1) * n)
    rows, lists = {}, []
    kind = "uint8" if counts.max(initial=0) < 256 else "int64"
    counts, places = counts.astype(kind), (pairs % n).astype("int32")
    for g in range(len(known)):
        s, e = starts[g], starts[g + 1]
        lists.append((places[s:e], counts[s:e]))
        if (e - s) * DENSE > n:
            rows[g] = row = np.zeros(n, kind)
            row[places[s:e]] = counts[s:e]
    return rows, lists


def _best(grams: np.ndarray, rows: dict[int, np.ndarray], lists: list[tuple[np.ndarray, np.ndarray]], n: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the ``limit`` entities that share most of the grams, the smaller place first among equals."""
    bound = sum(int(c.max()) for _, c in (lists[g] for g in grams) if len(c))
    shared = np.zeros(n, "uint8" if bound < 256 else "uint16" if bound < 65536 else "int64")
    for g in grams:
        if (row := rows.get(g)) is not None:
            np.add(shared, row, out=shared, casting="same_kind")
        else:
            places, counts = lists[g]
            shared[places] += counts.astype(shared.dtype, copy=False)
    low, high = 1, int(shared.max(initial=0))
    while low < high:  # the largest count that at least limit entities reach
        middle = (low + high + 1) // 2
        if np.count_nonzero(shared >= middle) >= limit:
            low = middle
        else:
            high = middle - 1
    at = np.flatnonzero(shared >= low)
    count = shared[at]
    if len(at) > limit:
        more = count > low
        at = np.concatenate([at[more], at[~more][: limit - np.count_nonzero(more)]])
        count = shared[at]
    order = np.argsort(-count.astype("int64"), kind="stable")
    return at[order], count[order]


def _told(found: list[tuple[int, np.ndarray, np.ndarray]], keys: pa.Table, ids: pa.Array, by: list[str]) -> pa.RecordBatch:
    sizes = [len(x[1]) for x in found]
    rows = keys.take(pa.array(np.repeat([x[0] for x in found], sizes))).combine_chunks()
    columns = {c: rows.column(c).combine_chunks() for c in by}
    columns["entity_id"] = ids.take(pa.array(np.concatenate([x[1] for x in found])))
    columns["match_count"] = pa.array(np.concatenate([x[2] for x in found]).astype("int64"))
    columns["rank"] = pa.array(np.concatenate([np.arange(1, k + 1, dtype="int32") for k in sizes]))
    return pa.RecordBatch.from_pydict(columns)
