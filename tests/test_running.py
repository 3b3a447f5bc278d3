"""Running sums and previous values, with keys in one task and in ranges."""

import pytest
from pyspark.sql import functions as F

from loomflow.operators import running, sorts


def rows(spark):
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 11))
    return spark.range(2000).select(key.alias("k"), (F.col("id") * 7919 % 2000).alias("o"), (F.col("id") % 5 - 2).alias("v"))


def plain(df):
    out, sums, last = set(), {}, {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        sums[r.k] = sums.get(r.k, 0) + r.v
        out.add((r.k, r.o, sums[r.k], last.get(r.k)))
        last[r.k] = r.v
    return out


@pytest.mark.parametrize("largest", [5_000_000, 100])
def test_both_ways(spark, monkeypatch, plan, largest):
    monkeypatch.setattr(running, "LARGEST_GROUP", largest)
    df = rows(spark)
    got = running.previous(running.running_sum(df, ["k"], ["o"], F.col("v"), "s"), ["k"], ["o"], "v", "p")
    assert {(r.k, r.o, r.s, r.p) for r in got.collect()} == plain(df)
    assert got.count() == 2000 and set(got.columns) == {"k", "o", "v", "s", "p"}
    ranks = sorts.secondary_rank(df.select("k", "o"), "k", ["o"])
    assert sorted(r.rank_no for r in ranks.where("k = 'hot'").collect()) == list(range(1, 1334))
    assert ranks.schema["rank_no"].dataType.simpleString() == "int"
    assert running.running_sum(df.limit(0), ["k"], ["o"], F.col("v"), "s").count() == 0


def test_null_values_carry_over(spark, monkeypatch):
    monkeypatch.setattr(running, "LARGEST_GROUP", 1)
    df = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = {r.o: r.p for r in running.previous(df, ["k"], ["o"], "v", "p").collect()}
    assert got == {i: (None if i == 0 else i - 1 if i % 2 else None) for i in range(60)}


@pytest.mark.parametrize("largest", [5_000_000, 100])
def test_carried_values(spark, monkeypatch, largest):
    monkeypatch.setattr(running, "LARGEST_GROUP", largest)
    df = rows(spark).withColumn("a", F.when(F.col("o") % 9 == 0, F.col("o"))).withColumn("b", F.when(F.col("o") % 400 == 7, F.lit("x")))
    want, last = set(), {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        a, b = last.get(r.k, (None, None))
        last[r.k] = (r.a if r.a is not None else a, r.b if r.b is not None else b)
        want.add((r.k, r.o, *last[r.k]))
    got = running.carried(df, ["k"], ["o"], ["a", "b"])
    assert {(r.k, r.o, r.a, r.b) for r in got.collect()} == want and got.count() == 2000
