"""Per-key results when a few keys hold most rows (problem 5).

Nothing here groups by the key alone before the rows have been reduced. The basis is a table of mergeable counts by
(key, value), counted on the map side and spread over all tasks by both; it is written once, and whatever follows reads
these counts, never a row again. Quantiles are found by exact selection: a first histogram tells in which slice of the value range a wanted
rank lies, and each further round counts that slice alone again, in finer slices, until a slice is a single value. A
histogram has at most ``2 ** SLICE_BITS`` slices for a key or a slice of a key, so that no task ever holds more than
that of a hot key, and its values are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.sources.tables import cut

#: Bits of the value resolved in a round at most.
SLICE_BITS = 10
#: Keys that are broadcast at most, as a filter of the counts.
MOST_BROADCAST = 100_000
_WANTED = "array<struct<q:double,rank:bigint>>"


class _Digits:
    """The bits in which the values of a table differ, as a number that orders like them, and the rounds to resolve it.

    Values share the bits above the highest one in which the smallest and the largest differ. Only if that is the sign
    it has to be turned round. Everything is bitwise, so no range of values overflows.
    """

    def __init__(self, rows: DataFrame):
        lo, hi, self.all_rows = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
        lo, hi = lo or 0, hi or 0
        bits = max(1, ((lo ^ hi) & (2**64 - 1)).bit_length())
        self.mask = _signed((1 << bits) - 1)
        self.flip = _signed(1 << 63) if bits == 64 else 0
        self.prefix = _signed(lo & ~((1 << bits) - 1))
        rounds = -(-bits // SLICE_BITS)
        #: For each round the bits to the right of the slice number; the rounds share the bits evenly.
        self.shifts = [bits - bits * (i + 1) // rounds for i in range(rounds)]

    def slice(self, v: Column, shift: int) -> Column:
        return F.shiftrightunsigned(v.bitwiseXOR(F.lit(self.flip)).bitwiseAND(F.lit(self.mask)), shift)

    def value(self, last_slice: Column) -> Column:
        return last_slice.bitwiseOR(F.lit(self.prefix)).bitwiseXOR(F.lit(self.flip))


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _keyed(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v"))


def _wanted(quantiles: Sequence[float], n_values: Column, before: Column, upto: Column) -> Column:
    """The quantiles whose rank lies in a slice, with the rank among the slice's own values.

    The 1-based rank of a quantile is that of the smallest value with at least q of the values at or below it.
    """
    ranks = [F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * n_values)).cast("long").alias("rank")) for q in quantiles]
    return _inside(F.array(*ranks), before, upto)


def _inside(wanted: Column, before: Column, upto: Column) -> Column:
    here = F.filter(wanted, lambda w: (w.rank > before) & (w.rank <= upto))
    return F.transform(here, lambda w: F.struct(w.q.alias("q"), (w.rank - before).alias("rank")))


def _first_round(counts: DataFrame, digits: _Digits, quantiles: Sequence[float]) -> DataFrame:
    """``(k, slice, wanted, n_rows, n_distinct)``: the slices that hold a wanted rank; the slice of nulls is kept too."""
    slices = counts.groupBy("k", digits.slice(F.col("v"), digits.shifts[0]).alias("slice")).agg(F.sum("n").alias("n"), F.count("v").alias("d"))
    whole = Window.partitionBy("k")
    there = F.when(F.col("slice").isNotNull(), F.col("n")).otherwise(0)
    first = slices.select(
        "k", "slice", F.sum("n").over(whole).alias("n_rows"), F.sum("d").over(whole).alias("n_distinct"), F.sum(there).over(whole).alias("n_values"),
        F.sum(there).over(whole.orderBy("slice")).alias("upto"), there.alias("n"),
    )
    wanted = F.when(F.col("slice").isNotNull(), _wanted(quantiles, F.col("n_values"), F.col("upto") - F.col("n"), F.col("upto"))).otherwise(F.array().cast(_WANTED))
    return first.select("k", "slice", wanted.alias("wanted"), "n_rows", "n_distinct").where("slice IS NULL OR size(wanted) > 0")


def _next_round(counts: DataFrame, found: DataFrame, digits: _Digits, i: int) -> DataFrame:
    """found of the round before, refined: the slices it names are counted again in finer ones.

    The slices that are wanted lie among the counts as rows of their own, so that counts and ranks meet in one exchange
    by key and slice, without a join.
    """
    above, fine = digits.slice(F.col("v"), digits.shifts[i - 1]).alias("above"), digits.slice(F.col("v"), digits.shifts[i]).alias("slice")
    values = counts.where("v IS NOT NULL")
    if digits.shifts[i]:
        values = values.groupBy("k", above, fine).agg(F.sum("n").alias("n"))
    else:  # a slice is a value already
        values = values.select("k", above, fine, "n")
    none = F.lit(None)
    histogram = values.select("k", "above", "slice", "n", none.cast(_WANTED).alias("wanted"), none.cast("long").alias("n_rows"), none.cast("long").alias("n_distinct"))
    # nulls first: the row of a wanted slice stands before its counts; that of a key's nulls stands alone
    marks = found.select("k", F.col("slice").alias("above"), none.cast("long").alias("slice"), F.lit(0).cast("long").alias("n"), "wanted", "n_rows", "n_distinct")
    order = Window.partitionBy("k", "above").orderBy("slice")
    upto = F.sum("n").over(order)
    mark = F.first(F.when(F.col("slice").isNull(), F.struct("wanted", "n_rows", "n_distinct"))).over(order)
    both = histogram.unionByName(marks).select("k", "above", "slice", "n", upto.alias("upto"), mark.alias("m")).where("m IS NOT NULL AND (slice IS NOT NULL OR above IS NULL)")
    resolved = both.select("k", "above", "slice", _inside(F.col("m.wanted"), F.col("upto") - F.col("n"), F.col("upto")).alias("wanted"), "m.n_rows", "m.n_distinct")
    return resolved.where("above IS NULL OR size(wanted) > 0").drop("above")


def _profile(counts: DataFrame, first: DataFrame, digits: _Digits, quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``(k, n_rows, n_distinct, <names>)`` of the keys of ``first``, after all rounds."""
    found = first
    for i in range(1, len(digits.shifts)):
        found = _next_round(counts, found, digits, i)
    each = found.select("k", "n_rows", "n_distinct", digits.value(F.col("slice")).alias("value"), F.explode_outer(F.transform("wanted", lambda w: w.q)).alias("q"))
    chosen = [F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for q, n in zip(quantiles, names)]
    return each.groupBy("k").agg(F.max("n_rows").alias("n_rows"), F.max("n_distinct").alias("n_distinct"), *chosen)


def _counts(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("k", "v").agg(F.count("*").alias("n")))


def key_profile(
    df: DataFrame,
    key: str,
    value: str,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    names: Sequence[str] = ("q25", "q50", "q75"),
) -> DataFrame:
    """For every key: ``(<key>, n_rows, n_distinct, <names>)``, evenly loaded whatever the skew.

    Defined cases: rows with a null key belong to no key; null values count in n_rows only; a key without values has
    n_distinct 0 and null quantiles; an empty table yields no rows. A quantile q is the smallest value with at least
    q of the key's values, repeats included, at or below it.
    """
    rows = _keyed(df, key, value).where(F.col("k").isNotNull())
    digits, counts = _Digits(rows), _counts(rows)
    return _profile(counts, _first_round(counts, digits, quantiles), digits, quantiles, names).withColumnRenamed("k", key)


def heavy_keys(
    df: DataFrame,
    key: str,
    value: str,
    share: float = 0.03,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    names: Sequence[str] = ("q25", "q50", "q75"),
) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with the columns of key_profile and ``share``.

    Which keys are heavy is known from the first histogram; the further rounds count their slices alone. At most
    1 / share keys can be heavy: only where that is MOST_BROADCAST or less are they broadcast, to keep the counts of
    other keys out of the further rounds. Rows with a null key count among all rows; the other cases are as in key_profile.
    """
    rows = _keyed(df, key, value)
    digits, counts = _Digits(rows), _counts(rows)
    first = _first_round(counts, digits, quantiles)
    heavy = cut(first.where(F.col("k").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.lit(digits.all_rows))))
    mine = counts
    if share > 0 and 1 / share <= MOST_BROADCAST:
        mine = counts.join(F.broadcast(heavy.select("k").distinct()), "k", "left_semi")
    out = _profile(mine, heavy, digits, quantiles, names)
    return out.select(F.col("k").alias(key), "n_rows", "n_distinct", *names, (F.col("n_rows") / F.lit(digits.all_rows)).alias("share"))
