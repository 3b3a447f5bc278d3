"""Sketches against exact ranks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomflow.llm.quantiles import SECTION, RankSketch, group_percentiles, merge_sketches, sketch_by, sketch_quantiles

SHARES = [0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999, 1.0]


def worst(values, sketch):
    """The largest rank error over its bound."""
    ordered, n, most = np.sort(values), len(values), 0.0
    for q, got in zip(SHARES, sketch.quantiles(SHARES)):
        target = min(max(math.ceil(q * n), 1), n)
        low, high = np.searchsorted(ordered, got, "left") + 1, np.searchsorted(ordered, got, "right")
        error = max(low - target, target - high, 0)
        most = max(most, error / ((n - target) / SECTION + 1))
    return most


@pytest.mark.parametrize("kind", ["uniform", "sorted", "reversed", "ties", "heavy"])
def test_relative_error(kind):
    rng = np.random.default_rng(5)
    values = {"uniform": rng.random(300_000), "ties": rng.integers(0, 50, 300_000), "heavy": rng.pareto(0.7, 300_000)}.get(kind, np.arange(300_000.0))
    values = values[::-1] if kind == "reversed" else values
    sketch = RankSketch()
    for part in np.array_split(values, 61):
        sketch.add(part)
    assert sketch.count == len(values)
    assert sum(len(p) << h for h, parts in enumerate(sketch.buffers) for p in parts) == len(values)
    assert sketch.held() < 20_000
    assert worst(values, sketch) <= 1


def test_merged_in_any_shape():
    rng = np.random.default_rng(6)
    parts = [rng.lognormal(0, 3, n) for n in (1, 10, 100_000, 5, 70_000, 3000, 0)] + [rng.random(2000) for _ in range(60)]
    sketches = []
    for p in parts:
        s = RankSketch()
        s.add(p)
        sketches.append(RankSketch.from_bytes(s.to_bytes()))
    while len(sketches) > 1:
        a, b = sketches.pop(0), sketches.pop(0)
        a.merge(b)
        sketches.append(RankSketch.from_bytes(a.to_bytes()))
    values = np.concatenate(parts)
    assert sketches[0].count == len(values)
    assert worst(values, sketches[0]) <= 1


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled", "zigzag", "organ"])
@pytest.mark.parametrize("merging", ["chain", "tree", "uneven", "one"])
@pytest.mark.parametrize("seed", range(4))
def test_stress(order, merging, seed):
    """Adverse orders and merges. The bound is measured by these runs, the coins being fixed."""
    rng = np.random.default_rng(seed)
    n = (20_000, 60_000, 120_000, 33_333)[seed]
    values = np.sort(rng.lognormal(0, 4, n) if seed % 2 else rng.integers(0, n // 3, n).astype(float))
    half = np.stack((values[: n // 2], values[n - n // 2 :][::-1]), axis=1).ravel()
    values = {"sorted": values, "reversed": values[::-1], "shuffled": rng.permutation(values), "zigzag": half, "organ": np.concatenate((values[::2], values[1::2][::-1]))}[order]
    cuts = np.sort(rng.integers(0, len(values), 40)) if merging == "uneven" else np.linspace(0, len(values), 41).astype(int)[1:-1]
    sketches = []
    for part in np.split(values, cuts):
        sketches.append(RankSketch())
        sketches[-1].add(part)
    if merging == "one":
        sketches = [RankSketch()]
        for part in np.split(values, cuts):
            sketches[0].add(part)
    while len(sketches) > 1:
        if merging == "tree":
            for a, b in zip(sketches[::2], sketches[1::2]):
                a.merge(b)
            sketches = sketches[::2]
        else:
            sketches[0].merge(sketches.pop(1))
    assert sketches[0].count == len(values) and worst(values, sketches[0]) <= 1


def test_no_task_reads_everything(spark, plan):
    """Neither a column without keys nor a hot key meets in one task before partial sketches are merged."""
    df = spark.range(0, 200_000, 1, 6).selectExpr("id % 1000 as v", "'hot' as k")
    for keys in ([], ["k"]):
        merged = merge_sketches(sketch_by(df, keys, "v"), keys)
        text = plan(merged).split("== Physical Plan ==")[1]
        assert "Coalesce 1" not in text and text.count("MapInArrow join") == 2 and text.count("Exchange") >= 2
        row = merged.withColumn("q", sketch_quantiles([0.5])).first()
        assert row["n"] == 200_000 and abs(row["q"][0] - 500) <= 1000 / 128 + 1
    assert merge_sketches(sketch_by(df.limit(0), [], "v"), []).count() == 0


def test_small_is_exact_and_empty():
    s = RankSketch()
    s.add(np.array([3.0, 1.0, 2.0, 2.0]))
    assert s.quantiles([0.25, 0.5, 0.75, 1.0]) == [1.0, 2.0, 2.0, 3.0]
    assert RankSketch().quantiles([0.5]) == [None]


def test_groups_with_a_hot_one_nulls_and_clashes(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 1000)).alias("k"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), F.lit(1).alias("n"), F.lit("x").alias("sketch"), F.lit(0).alias("p50"),
    )
    got = {r["k"]: r for r in group_percentiles(df, ["k"], "v", {"p50": 0.5, "p100": 1.0}).collect()}
    exact = df.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), F.max("v").alias("most"), F.expr("percentile_disc(0.5) within group (order by v)").alias("p50"))
    rows = exact.collect()
    assert len(rows) == len(got)
    for r in rows:
        assert got[r["k"]]["n"] == r["n"] and got[r["k"]]["p100"] == r["most"]
        # small groups are exact; of the two large ones every rank is 3 or 4 apart
        assert abs(got[r["k"]]["p50"] - r["p50"]) <= (4 * (r["n"] / 2 / SECTION + 1) if r["n"] > 100 else 0)


def test_days_equal_whole(spark):
    df = spark.range(5000).select((F.col("id") % 5).alias("g"), (F.col("id") % 9).alias("day"), F.hash("id").alias("v"))
    days = merge_sketches(sketch_by(df, ["g", "day"], "v"), ["g", "day"])
    assert days.count() == 45
    total = merge_sketches(days, ["g"]).select("g", "n", sketch_quantiles([0.5])[0].alias("m")).collect()
    assert sorted((r["g"], r["n"]) for r in total) == [(g, 1000) for g in range(5)]
    everything = merge_sketches(days, []).collect()
    assert len(everything) == 1 and everything[0]["n"] == 5000


def test_empty_table_nan_and_infinity(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("a", float("inf")), ("a", 1.0)], "k string, v double")
    assert [tuple(r) for r in group_percentiles(df, ["k"], "v", {"p50": 0.5}).collect()] == [("a", 2, 1.0)]
    assert group_percentiles(df.limit(0), ["k"], "v", {"p50": 0.5}).count() == 0
