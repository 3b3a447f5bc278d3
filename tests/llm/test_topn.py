"""Top N per group against a window."""

import random

import pytest

from loomflow.llm.topn import top_n_per_group


def brute(rows, n):
    items = {}
    for k, s, i in rows:
        if s is not None and s == s:
            items[(k, i)] = max(items.get((k, i), s), s)
    groups = {}
    for (k, i), s in items.items():
        groups.setdefault(k, []).append((-s, i is None, (i or "").encode(), i, s))
    return {(k, r, s, i) for k, g in groups.items() for r, (_, _, _, i, s) in enumerate(sorted(g, key=lambda x: x[:3])[:n], 1)}


def run(spark, rows, n, kind="long"):
    df = spark.createDataFrame(rows, f"k string, s {kind}, i string")
    got = [tuple(r) for r in top_n_per_group(df, ["k"], "s", "i", n).collect()]
    assert len(got) == len(set(got))
    return {(k, r, s, i) for k, r, s, i in got}


def test_ties_resolved_by_long_identifiers(spark):
    rng = random.Random(2)
    names = [f"attempt_{'x' * 30}_{rng.randrange(10**9):012d}" for _ in range(900)]
    rows = [("hot", 7, i) for i in names] + [("hot", 7, "attempt_")] + [("b", k % 3, i) for k, i in enumerate(names[:40])]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_hard_identifiers(spark):
    rows = [("a", 1, i) for i in ("", "a", "a\0", "aa", "ab", "é", "zz", "a" * 50, "a" * 50 + "b", "\U0001f600", None)]
    for n in (1, 3, 11, 20):
        assert run(spark, rows, n) == brute(rows, n)


def test_extreme_scores_and_repeats(spark):
    big = 2**63 - 1
    rows = [("a", s, f"i{k}") for k, s in enumerate([big, big - 1, -big, 0, -1, 1, big, None, big - 2])] + [("a", 5, "i3"), ("a", 5, "i3"), (None, 4, "n1"), (None, 4, "n2"), ("b", None, "x")]
    for n in (1, 2, 4):
        assert run(spark, rows, n) == brute(rows, n)


def test_doubles(spark):
    rows = [("a", s, f"i{k}") for k, s in enumerate([0.1, 0.1000001, -0.5, 1e300, float("nan"), None, 0.1, 1e-300, float("inf")])]
    assert run(spark, rows, 4, "double") == brute(rows, 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_with_hot_group(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if k % 3 == 0 else f"g{rng.randrange(60)}", rng.choice([rng.randrange(5), rng.randrange(10**9)]), f"id{rng.randrange(2000)}") for k in range(4000)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, "x", 9, 9)], "k string, s int, i string, rank_no int, __s int")
    got = top_n_per_group(df, ["k"], "s", "i", 2)
    assert [tuple(r) for r in got.collect()] == [("a", 1, 1, "x")] and dict(got.dtypes)["s"] == "int"
    assert top_n_per_group(df.limit(0), ["k"], "s", "i", 2).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, ["k"], "s", "i", 0)
