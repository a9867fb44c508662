import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from linkspark.operators.components import attach_incomplete
from linkspark.operators.heavy_keys import heavy_keys, key_profile
from linkspark.operators.snapshots import snapshot_changes, snapshot_digests

SCHEMA = "snapshot_no int, loaded_at timestamp_ntz, corporate_number string, name string, address string, node string, k string"


def changes(spark, rows):
    return sorted(map(tuple, snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()))


def at(n):
    return datetime(2024, 1, 1) + timedelta(hours=n)


def test_small_cases(spark):
    rows = [
        (1, at(1), "a", "x", None, "", ""), (3, at(2), "a", "x", None, "", ""),  # null equals null; 2 doesn't exist
        (1, at(1), "b", "x", None, "", ""), (3, at(2), "b", "x", "", "", ""),  # null differs from ''
        (1, at(1), "c", "old", "p", "", ""), (1, at(5), "c", "new", "p", "", ""), (3, at(2), "c", "new", "p", "", ""),  # the later load stands
        (1, at(1), "d", "x", "p", "", ""), (3, at(2), "e", "x", "p", "", ""), (3, None, "e", "y", "p", "", ""),
        (1, at(1), None, "x", "p", "", ""), (None, at(1), "f", "x", "p", "", ""),
        (4, at(3), "a", "x" * 100_000, None, "", ""), (4, at(3), "b", "x", "", "", ""), (4, at(3), "c", "new", "p", "", ""), (4, at(3), "e", "x", "p", "", ""),
    ]
    assert changes(spark, rows) == [(3, "b", "changed"), (3, "d", "removed"), (3, "e", "added"), (4, "a", "changed")]
    assert changes(spark, []) == [] and changes(spark, rows[:1]) == []


def test_equal_snapshots_and_repeats(spark):
    rows = [(s, at(s), f"{i}", "n", "a", "", "") for s in (1, 2) for i in range(300)] * 2
    assert changes(spark, rows) == []
    got = {tuple(r) for r in snapshot_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 600, 300), (2, 600, 300)}


def test_snapshots_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 4), at(rnd.randint(0, 10_000)), str(rnd.randint(0, 400)), rnd.choice(["a", "b", None]), rnd.choice(["p", "q", None, ""]), "", "") for _ in range(2000)]
    state = defaultdict(dict)
    for s, t, k, n, a, *_ in sorted(rows, key=lambda r: (r[1], r[3] is not None, r[3] or "", r[4] is not None, r[4] or "")):
        state[s][k] = (n, a)
    want = []
    for s in (2, 3, 4):
        for k in state[s].keys() | state[s - 1].keys():
            if k not in state[s - 1]:
                want.append((s, k, "added"))
            elif k not in state[s]:
                want.append((s, k, "removed"))
            elif state[s][k] != state[s - 1][k]:
                want.append((s, k, "changed"))
    assert changes(spark, rows) == sorted(want)


def quantile(values, q):
    v = sorted(values)
    import math

    return v[max(1, math.ceil(q * len(v))) - 1]


def test_profiles_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [("hot", rnd.randint(-5, 70_000)) for _ in range(4000)] + [(rnd.choice("abcdef"), rnd.choice([1, 2, None, 99_999])) for _ in range(3000)] + [("none", None), (None, 5), ("big", -(2**62)), ("big", 2**62)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "k string, v bigint, slice string")
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    got = {r.k: r for r in key_profile(df, "k", "v").collect()}
    assert set(got) == set(by)
    for k, vs in by.items():
        there = [v for v in vs if v is not None]
        assert (got[k].n_rows, got[k].n_distinct) == (len(vs), len(set(there)))
        assert [got[k].q25, got[k].q50, got[k].q75] == ([quantile(there, q) for q in (0.25, 0.5, 0.75)] if there else [None] * 3)
    heavy = {r.k: r for r in heavy_keys(df, "k", "v").collect()}
    assert set(heavy) == {k for k, vs in by.items() if len(vs) >= 0.03 * len(rows)}
    for k, r in heavy.items():
        assert (r.n_rows, r.n_distinct, r.q50) == (got[k].n_rows, got[k].n_distinct, got[k].q50)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("a", 7)] * 5])
def test_profile_edges(spark, rows):
    df = spark.createDataFrame(rows, "k string, v bigint")
    want = [("a", 5, 1, 7, 7, 7)] if rows[:1] == [("a", 7)] else []
    assert [tuple(r) for r in key_profile(df, "k", "v").collect()] == want
    assert [tuple(r)[:6] for r in heavy_keys(df, "k", "v").collect()] == want


def test_incomplete_components_join_one_only(spark):
    parts = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, None), (3, 1)], "component bigint, rank int")
    links = spark.createDataFrame([(3, 1), (4, 1), (4, 2), (5, 3), (5, 1), (6, 4), (7, 6), (7, 6), (None, 1)], "component bigint, other bigint")
    # 3 fits 1 alone, 4 fits two; 5 fits 3, which is 1; 6 follows 4, which stayed apart, and 7 follows 6
    want = {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 4, 7: 4, 8: 8}
    assert {r.component: r.label for r in attach_incomplete(parts, links, 4).collect()} == want
    assert {r.component: r.label for r in attach_incomplete(parts, links.limit(0), 4).collect()} == {k: k for k in want}
