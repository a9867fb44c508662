"""Connected components of a graph given by its edges, with the edges never leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.sources.tables import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node of it.

    Alternates large-star and small-star rounds (Kiveris et al. 2014): every node links its larger neighbours, then its
    smaller ones, to the smallest it knows. The number of rounds grows with the logarithm of the size, edges shrink to
    stars, and each round is cut by a checkpoint. Hot nodes are no problem beyond their own degree: the minimum of the
    neighbours is aggregated before it is joined. Null ends, loops and repeated edges are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    stars = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u go to the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        stars = cut(small.where("u <> v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    centres = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def pairs_within(members: DataFrame, group: str, member: str, a: str, b: str) -> DataFrame:
    """``(a, b)``: every pair of distinct members of a group, a < b; each pair once. Null groups and members are left out."""
    m = members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL AND m IS NOT NULL").distinct()
    left, right = m.withColumnRenamed("m", a), m.withColumnRenamed("m", b)
    return left.join(right, "g").where(F.col(a) < F.col(b)).select(a, b).distinct()


def attach_incomplete(components: DataFrame, links: DataFrame, ranks: int) -> DataFrame:
    """``(component, label)``: which component each one belongs to after incomplete ones were attached.

    components: ``(component, rank)``, rank 0 for complete ones and more the less is known, below ``ranks``. links:
    ``(component, other)``, where ``component`` has a higher rank than ``other`` and would fit it. An incomplete
    component joins another one only if exactly one fits it among the most complete that fit: what fits several says
    nothing of them being one. Ranks are taken in order, so that a component may follow one that was attached itself.
    A missing rank counts as 0; repeated rows count once; components without links keep their own label.
    """
    named = components.groupBy("component").agg(F.coalesce(F.min("rank"), F.lit(0)).alias("rank"))
    labels = named.select("component", "rank", F.col("component").alias("label"), F.col("rank").alias("label_rank"))
    for rank in range(1, ranks):
        mine = labels.where(F.col("rank") == rank).select("component")
        others = labels.where(F.col("rank") < rank).select(F.col("component").alias("other"), F.col("label").alias("to"), F.col("label_rank").alias("to_rank"))
        fitting = links.join(mine, "component").join(others, "other").groupBy("component").agg(
            F.min(F.struct("to_rank", "to")).alias("lo"), F.max(F.struct(-F.col("to_rank"), "to")).alias("hi")
        )
        one = fitting.where(F.col("lo.to") == F.col("hi.to")).select("component", "lo.to", "lo.to_rank")
        labels = cut(
            labels.join(one, "component", "left").select("component", "rank", F.coalesce("to", "label").alias("label"), F.coalesce("to_rank", "label_rank").alias("label_rank"))
        )
    return labels.select("component", "label")
