"""What changed between full snapshots of a table (problem 3).

The keys are bucketed into hash ranges. Three levels of digests stand over the rows: a leaf (a small range of key
hashes), a node (a range of leaves) and the root (a whole snapshot). A digest is the exclusive or and the count of the
row hashes below it, so it doesn't depend on the order of rows and is mergeable. The levels are compared top-down
against the delivery before, and single rows are compared only in leaves whose digests differ.

All of this happens behind ONE exchange, of the compared columns by node: grouping by leaf and by key and the windows
over a node need no other one, and nothing is joined but the list of deliveries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Expected rows of a snapshot under one leaf, and leaves under one node.
LEAF_ROWS = 8
NODE_LEAVES = 32


def row_digest(columns: Sequence[Column]) -> Column:
    """64-bit hash of the columns in which a null differs from every value, the empty string included."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(*parts)


def _bits(rows: int, snapshots: int) -> tuple[int, int]:
    """Bits of the node number and of the leaf number within the node, from the table's size."""
    leaves = max(1, rows // max(1, snapshots) // LEAF_ROWS)
    leaf = NODE_LEAVES.bit_length() - 1
    return max(0, leaves.bit_length() - leaf), leaf


def snapshot_changes(
    df: DataFrame,
    key: str = "corporate_number",
    snapshot: str = "snapshot_no",
    loaded_at: str = "loaded_at",
    compare: Sequence[str] = ("name", "address"),
) -> DataFrame:
    """Changes of each delivery against the one before: ``(snapshot_no, <key>, change_kind)``.

    ``change_kind`` is ``added``, ``removed`` or ``changed`` (one of ``compare`` differs; null equals null only).

    Defined cases: rows whose key or snapshot number is null are no records. Of several rows of a key in a snapshot the
    one loaded last stands (a null load time counts as earliest; equal times: the greatest values in the order of
    ``compare``). The delivery before is the next lower snapshot number that exists; the lowest one yields nothing. An
    empty table yields no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(
        F.col(snapshot).cast("int").alias("s"),
        F.col(key).alias("k"),
        F.col(loaded_at).alias("at"),
        F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(compare)]).alias("v"),
    ).where(F.col("s").isNotNull() & F.col("k").isNotNull())
    deliveries = rows.groupBy("s").count().orderBy("s").collect()  # a row per delivery
    node_bits, leaf_bits = _bits(sum(r["count"] for r in deliveries), len(deliveries))
    numbers = [r["s"] for r in deliveries]
    # each version of a row is new in its own delivery and old in the next one
    following = dict(zip(numbers, numbers[1:]))
    roles = [(s, s, True) for s in numbers[1:]] + [(s, n, False) for s, n in following.items()]
    spark = df.sparkSession
    plan = spark.createDataFrame(roles, "s int, at_s int, is_new boolean")  # two rows per delivery

    h = F.xxhash64("k")
    placed = rows.withColumn("node", F.shiftrightunsigned(h, 64 - node_bits) if node_bits else F.lit(0).cast("long"))
    placed = placed.withColumn("leaf", h.bitwiseAND(F.lit((1 << leaf_bits) - 1)).cast("int"))
    placed = placed.repartition("node")
    standing = placed.groupBy("node", "leaf", "s", "k").agg(F.max_by("v", F.struct("at", "v")).alias("v"))
    hashed = standing.select(
        "node", "leaf", "s", "k", row_digest([F.col("k"), *[F.col(f"v.v{i}") for i in range(len(compare))]]).alias("h")
    )
    leaves = hashed.groupBy("node", "leaf", "s").agg(
        F.bit_xor("h").alias("h"), F.count("*").alias("n"), F.collect_list(F.struct("k", "h")).alias("rows")
    )
    sided = leaves.join(F.broadcast(plan), "s").drop("s")

    def side(c: str, new: bool) -> Column:
        return F.when(F.col("is_new") == new, F.col(c))

    # root: one row per delivery
    ends = {new: (F.coalesce(F.bit_xor(side("h", new)), F.lit(0)), F.coalesce(F.sum(side("n", new)), F.lit(0))) for new in (True, False)}
    root_differs = (ends[True][0] != ends[False][0]) | (ends[True][1] != ends[False][1])
    roots = sided.groupBy("at_s").agg(root_differs.alias("d")).where("d").select("at_s")
    in_root = sided.join(F.broadcast(roots), "at_s", "left_semi")
    by_node = Window.partitionBy("node", "at_s")
    in_node = in_root.withColumn("d", _differs(side, by_node)).where("d").drop("d")
    in_leaf = in_node.withColumn("d", _differs(side, Window.partitionBy("node", "at_s", "leaf"))).where("d").drop("d")
    diff = in_leaf.select("node", "leaf", "at_s", "is_new", F.inline("rows"))
    per_key = diff.groupBy("node", "leaf", "at_s", "k").agg(
        F.max(side("h", True)).alias("new"), F.max(side("h", False)).alias("old")
    )
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("new") != F.col("old"), "changed")
    )
    return per_key.select(F.col("at_s").alias(snapshot), F.col("k").alias(key), kind.alias("change_kind")).where(
        F.col("change_kind").isNotNull()
    )


def _differs(side, over: Window) -> Column:
    """Whether the new and the old digest of a range differ; a range without rows has digest and count 0."""

    def total(f, c: str, new: bool) -> Column:
        return F.coalesce(f(side(c, new)).over(over), F.lit(0))

    return (total(F.bit_xor, "h", True) != total(F.bit_xor, "h", False)) | (
        total(F.sum, "n", True) != total(F.sum, "n", False)
    )


def snapshot_digests(
    df: DataFrame,
    key: str = "corporate_number",
    snapshot: str = "snapshot_no",
) -> DataFrame:
    """Rows and standing keys of each delivery: ``(snapshot_no, n_rows, n_keys)``; nulls as in snapshot_changes."""
    rows = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
    per_key = rows.groupBy(F.col(snapshot).alias("s"), F.col(key).alias("k")).agg(F.count("*").alias("n"))
    return per_key.groupBy(F.col("s").alias(snapshot)).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
