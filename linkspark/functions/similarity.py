"""Similarities of two texts in 0..1.

Spark has the edit distance built in. Jaro-Winkler and the Indel ratio have two engines: vectorised kernels with bit
masks (the default; Hyyrö's bit-parallel longest common subsequence), and pure Column folds for sessions without Python
workers. Both give the same values.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_SCALE, PREFIX_LENGTH, BOOST_ABOVE = 0.1, 4, 0.7


@lru_cache(maxsize=65_536)
def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler similarity; the prefix counts only above BOOST_ABOVE."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    where, free, met, order = _masks(b), (1 << len(b)) - 1, [], []
    for i, c in enumerate(a):
        lo = max(i - reach, 0)
        window = ((1 << (i + reach + 1)) - 1) >> lo << lo
        if hit := where.get(c, 0) & free & window:
            low = hit & -hit
            free ^= low
            met.append(c)
            order.append(low.bit_length() - 1)
    m = len(met)
    if not m:
        return 0.0
    out_of_order = sum(c != b[j] for c, j in zip(met, sorted(order))) // 2
    jaro = (m / len(a) + m / len(b) + (m - out_of_order) / m) / 3
    if jaro <= BOOST_ABOVE:
        return jaro
    common = next((i for i, (x, y) in enumerate(zip(a[:PREFIX_LENGTH], b)) if x != y), min(PREFIX_LENGTH, len(a), len(b)))
    return jaro + common * PREFIX_SCALE * (1 - jaro)


def indel_ratio_of(a: str, b: str) -> float:
    """2 * LCS / (length of both); 1.0 for two empty texts."""
    if not a and not b:
        return 1.0
    where, full = _masks(a), (1 << len(a)) - 1
    state = full
    for c in b:
        met = state & where.get(c, 0)
        state = ((state + met) | (state - met)) & full
    return 2 * (len(a) - state.bit_count()) / (len(a) + len(b))


#: Letters of a text that fit the bits of a word; pairs with a longer one are taken one by one.
WORD = 64
#: Pairs that are computed together.
TOGETHER = 4096


def _letters(texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each text, and a word in which its letters' bits are set."""
    width = max(1, int(lengths.max()))
    codes = np.array(texts, dtype=f"U{width}").view("uint32").reshape(len(texts), width)
    return codes, ~np.uint64(0) >> (WORD - lengths).clip(0, WORD - 1).astype("uint64")


def _where(codes: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """For each row a word with bits where it has the row's letter."""
    packed = np.packbits(codes == letter[:, None], axis=1, bitorder="little")
    out = np.zeros((len(codes), 8), "uint8")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")[:, 0]


def _jaro_winkler_together(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """jaro_winkler_of of pairs of 1 to WORD letters."""
    x, _ = _letters(a, la)
    y, whole = _letters(b, lb)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free, one = whole.copy(), np.uint64(1)
    met = np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        top = ~np.uint64(0) >> (WORD - np.minimum(i + reach + 1, WORD)).astype("uint64")
        window = top & ~((one << np.maximum(i - reach, 0).astype("uint64")) - one)
        hit = np.where(i < la, _where(y, x[:, i]) & free & window, np.uint64(0))
        free ^= hit & (~hit + one)
        met[:, i] = hit != 0
    taken = np.unpackbits((whole & ~free).view("uint8").reshape(len(b), 8), axis=1, bitorder="little")[:, : y.shape[1]].astype(bool)
    m = met.sum(axis=1)
    # both sides have as many met letters in a row, so that these stand beside each other
    out_of_order = np.bincount(np.repeat(np.arange(len(a)), m), weights=x[met] != y[taken], minlength=len(a)) // 2
    some = np.maximum(m, 1)
    jaro = (m / la + m / lb + (m - out_of_order) / some) / 3
    n = min(PREFIX_LENGTH, x.shape[1], y.shape[1])
    same = (x[:, :n] == y[:, :n]) & (np.arange(n) < np.minimum(la, lb)[:, None])
    common = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(m == 0, 0.0, np.where(jaro <= BOOST_ABOVE, jaro, jaro + common * PREFIX_SCALE * (1 - jaro)))


def _indel_ratio_together(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """indel_ratio_of of pairs of 1 to WORD letters."""
    x, whole = _letters(a, la)
    y, _ = _letters(b, lb)
    state = whole.copy()
    for j in range(y.shape[1]):
        met = np.where(j < lb, state & _where(x, y[:, j]), np.uint64(0))
        state = ((state + met) | (state - met)) & whole
    return 2 * (la - np.bitwise_count(state).astype("int64")) / (la + lb)


def _scores(a: list[str], b: list[str], kernel, together) -> np.ndarray:
    """The kernel's values, by words where both texts fit one."""
    la, lb = (np.fromiter(map(len, x), "int64", len(x)) for x in (a, b))
    fits = (la > 0) & (lb > 0) & (la <= WORD) & (lb <= WORD)
    out = np.empty(len(a))
    for i in np.flatnonzero(~fits):
        out[i] = kernel(a[i], b[i])
    by_length = np.flatnonzero(fits)
    by_length = by_length[np.argsort(la[by_length] + lb[by_length], kind="stable")]
    for at in range(0, len(by_length), TOGETHER):
        i = by_length[at : at + TOGETHER]
        out[i] = together([a[k] for k in i], [b[k] for k in i], la[i], lb[i])
    return out


def _vectorised(kernel, together):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b))
        each = {pair: None for pair in pairs if pair[0] is not None and pair[1] is not None}
        if each:
            each = dict(zip(each, _scores(*map(list, zip(*each)), kernel, together).tolist()))
        return pd.Series([each.get(pair) for pair in pairs], dtype="float64")

    return run


def jaro_winkler(a: Column, b: Column, engine: str = "kernel") -> Column:
    """Jaro-Winkler of the lower-cased texts; 1 for two empty texts, 0 for one."""
    return jaro_winkler_prepared(engine)(F.lower(a), F.lower(b))


def jaro_winkler_prepared(engine: str = "kernel"):
    """Jaro-Winkler of texts in lower case already."""
    return _vectorised(jaro_winkler_of, _jaro_winkler_together) if engine == "kernel" else _jaro_winkler_fold


def levenshtein(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the lower-cased texts; 1 for two empty texts."""
    return levenshtein_prepared(F.lower(a), F.lower(b))


def levenshtein_prepared(x: Column, y: Column) -> Column:
    """The same of texts in lower case already."""
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / n)


def sorted_tokens(c: Column) -> Column:
    """The words in code point order, joined by blanks."""
    words = F.filter(F.split(c, "[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def token_sort(a: Column, b: Column, engine: str = "kernel") -> Column:
    """Indel ratio of the sorted words, case as it is."""
    return indel_prepared(engine)(sorted_tokens(a), sorted_tokens(b))


def indel_prepared(engine: str = "kernel"):
    """The Indel ratio of texts whose words are sorted already."""
    return _vectorised(indel_ratio_of, _indel_ratio_together) if engine == "kernel" else _indel_fold


def _indel_fold(x: Column, y: Column) -> Column:
    cs, ds = F.split(x, ""), F.split(y, "")
    start = F.array_repeat(F.lit(0), F.length(y) + 1)

    def row(before: Column, c: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(y)),
            F.array(F.lit(0)),
            lambda now, j: F.array_append(now, F.when(F.get(ds, j - 1) == c, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(now, j - 1)))),
        )

    lcs = F.element_at(F.aggregate(cs, start, row), -1)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(2 * lcs / (F.length(x) + F.length(y)))


def _jaro_winkler_fold(x: Column, y: Column) -> Column:
    n, m = F.length(x), F.length(y)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    cs, ds = F.split(x, ""), F.split(y, "")
    state = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("met"))

    def step(s: Column, i: Column) -> Column:
        lo, hi = F.greatest(i - reach, F.lit(0)), F.least(i + reach, m - 1)
        places = F.when(lo <= hi, F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda j: (F.get(ds, j) == F.get(cs, i)) & ~F.array_contains(s.used, j))).otherwise(F.array().cast("array<int>"))
        found = F.get(places, F.lit(0))
        return F.when(found.isNull(), s).otherwise(F.struct(F.array_append(s.used, found).alias("used"), F.array_append(s.met, F.get(cs, i)).alias("met")))

    folded = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), state, step)

    def score(s: Column) -> Column:
        count = F.size(s.used)
        other = F.transform(F.array_sort(s.used), lambda j: F.get(ds, j))
        swaps = F.floor(F.size(F.filter(F.zip_with(s.met, other, lambda p, q: p != q), lambda z: z)) / 2)
        jaro = (count / n + count / m + (count - swaps) / count) / 3
        common = F.aggregate(F.sequence(F.lit(1), F.lit(PREFIX_LENGTH)), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= F.least(n, m)) & (F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)), i).otherwise(k))
        return F.when(count == 0, 0.0).when(jaro > BOOST_ABOVE, jaro + common * PREFIX_SCALE * (1 - jaro)).otherwise(jaro)

    scored = F.get(F.transform(F.array(folded), score), F.lit(0))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(scored)
