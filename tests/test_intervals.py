"""Periods and gaps against a plain sweep."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomflow.operators.intervals import periods_and_gaps, unite


def sweep(rows):
    out, by = set(), {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and s <= t:
            by.setdefault(e, []).append((s, t))
    for e, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for s, t in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(e, "period", s, t) for s, t in merged}
        out |= {(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, width=86_400_000):
    df = spark.createDataFrame(rows, "c string, s long, e long, kind string, entity int, lo int" if len(rows and rows[0] or ()) > 3 else "c string, s long, e long")
    got = [tuple(r) for r in periods_and_gaps(df, "c", "s", "e", width).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_touching_nested_adjacent(spark):
    rows = [("a", 1, 5), ("a", 5, 7), ("a", 8, 9), ("a", 2, 3), ("a", 20, 20), ("a", 20, 20), ("b", 4, 3), (None, 1, 2), ("c", None, 2), ("d", -10, -5), ("d", -4, 6)]
    assert run(spark, rows) == sweep(rows)
    assert ("a", "gap", 7, 8) in run(spark, rows)  # neighbours share no instant


def test_across_shards(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s = rng.randrange(0, 4000)
        rows.append((f"e{i % 7}" if i % 3 else "hot", s, s + rng.choice([0, 1, 5, 9, 10, 11, 300])))
    for width in (1, 10, 97):
        assert run(spark, rows, width) == sweep(rows)


def test_long_intervals_are_cut_in_few_pieces(spark):
    rows = [("a", 0, 10**13), ("a", 5, 6), ("b", 10**13 + 1, 10**13 + 2), ("a", 10**13 + 2, 10**13 + 3)]
    assert run(spark, rows, 10) == sweep(rows)


@pytest.mark.parametrize("end", [10**18, 2**63 - 1])
def test_one_senseless_end_changes_no_other_row(spark, end):
    """Nanoseconds among milliseconds: neither other containers nor the shards' width depend on them."""
    rows = spark.range(30_000).selectExpr("concat('c', id) as c", "10L as s", "20L as e")
    df = rows.unionByName(spark.createDataFrame([("x", 15, end), ("c1", -(2**63), -(2**63) + 3), ("x", end - 1, end)], "c string, s long, e long"))
    got = {tuple(r) for r in periods_and_gaps(df, "c", "s", "e").collect()}
    want = {(f"c{i}", "period", 10, 20) for i in range(30_000)} | {("x", "period", 15, end), ("c1", "period", -(2**63), -(2**63) + 3), ("c1", "gap", -(2**63) + 3, 10)}
    assert got == want


def test_shards_have_a_fixed_width_and_long_intervals_one_row(spark):
    from loomflow.operators.intervals import SHARD_UNITS, run_bitmaps

    df = spark.createDataFrame([("a", 5, 10**18), ("a", 7 * SHARD_UNITS + 3, 7 * SHARD_UNITS + 4), ("b", 1, 2)], "entity string, s long, e long")
    rows = sorted((r.entity, r.shard, r.upto) for r in run_bitmaps(df, SHARD_UNITS).collect())
    last = 10**18 // SHARD_UNITS
    assert rows == [("a", 0, 0), ("a", 1, last - 1), ("a", 7, 7), ("a", last, last), ("b", 0, 0)]


def test_unite_keeps_groups_apart():
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(20_000), 2)
    lo = rng.integers(0, 100, 40_000)
    hi = lo + rng.integers(0, 30, 40_000)
    hi[7] = 2**62
    got = {}
    for g, a, b in zip(*(x.tolist() for x in unite(group, lo, hi))):
        got.setdefault(g, []).append((a, b))
    for g in range(20_000):
        spans = sorted(zip(lo[2 * g : 2 * g + 2].tolist(), hi[2 * g : 2 * g + 2].tolist()))
        whole = [(spans[0][0], max(x[1] for x in spans))] if spans[1][0] <= spans[0][1] + 1 else spans
        assert got[g] == whole


@pytest.mark.parametrize("gathered", [1, 3, 50])
def test_groups_over_several_batches(spark, monkeypatch, gathered):
    import loomflow.operators.intervals as module

    monkeypatch.setattr(module, "GATHERED", gathered)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(9)
        rows = [(f"e{i % 3}" if i % 4 else "hot", s, s + rng.choice([0, 2, 40, 500])) for i in range(300) for s in [rng.randrange(3000)]]
        for width in (5, 100, 10_000):
            assert run(spark, rows, width) == sweep(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_extra_columns(spark):
    assert run(spark, [("a", None, None)]) == set()
    assert spark.createDataFrame([], "c string, s long, e long").transform(lambda d: periods_and_gaps(d, "c", "s", "e")).count() == 0
    df = spark.createDataFrame([("a", 1, 2, "period", 9)], "c string, s long, e long, kind string, entity int")
    assert [tuple(r) for r in periods_and_gaps(df, "c", "s", "e").collect()] == [("a", "period", 1, 2)]
    same = spark.createDataFrame([(1, 2, 3)], "entity long, lo long, hi long")
    assert [tuple(r) for r in periods_and_gaps(same, "entity", "lo", "hi").collect()] == [(1, "period", 2, 3)]


def test_partition_count_does_not_matter(spark):
    rows = [(f"e{i % 3}", i * 3 % 50, i * 3 % 50 + i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, s long, e long")
    one, many = periods_and_gaps(df.coalesce(1), "c", "s", "e", 7), periods_and_gaps(df.repartition(9), "c", "s", "e", 7)
    assert set(map(tuple, one.collect())) == set(map(tuple, many.collect())) == sweep(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(-40, 40), st.integers(-40, 40)), min_size=1, max_size=40), st.sampled_from([1, 3, 16]))
def test_random(spark, rows, width):
    assert run(spark, rows, width) == sweep(rows)


def test_no_cross_join(spark, plan):
    df = spark.createDataFrame([("a", 1, 2)], "c string, s long, e long")
    text = plan(periods_and_gaps(df.withColumn("x", F.lit(1)), "c", "s", "e"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
