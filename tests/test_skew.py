"""Heavy keys: detection, salted aggregation, joins, per-key results."""

from pyspark.sql import functions as F

from loomflow.operators import heavy
from loomflow.operators.skew import heavy_keys, hot_join, salted_aggregate


def rows(spark, n=3000):
    """A third of all rows have one key, a few none, the rest one each."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id")))
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"), F.lit("x").alias("n_rows"), F.lit(1).alias("__heavyish"))


def test_heavy_keys_bounded_and_found(spark):
    found = {r["k"]: r["heavy_rows"] for r in heavy_keys(rows(spark), ["k"]).collect()}
    assert found["hot"] == 1000
    assert len(found) <= 4 * 4


def test_salted_equals_plain(spark):
    df = rows(spark)
    got = salted_aggregate(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v"), "d": F.count_distinct("v")}, {"n": F.sum, "s": F.sum, "d": F.sum}, ["v"], salts=5)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.count_distinct("v").alias("d"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salting_is_in_the_plan(spark, plan):
    text = plan(salted_aggregate(rows(spark), ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum}, ["v"]))
    assert "__salt" in text and "CartesianProduct" not in text


def test_empty_and_all_equal(spark):
    empty = rows(spark, 0)
    assert salted_aggregate(empty, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum}, ["v"]).count() == 0
    one = spark.range(100).select(F.lit("a").alias("k"), F.lit(None).cast("long").alias("v"))
    assert [tuple(r) for r in salted_aggregate(one, ["k"], {"n": F.count("v")}, {"n": F.sum}, ["v"]).collect()] == [("a", 0)]


def test_hot_join_keeps_every_row(spark):
    df = rows(spark)
    state = df.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    joined = hot_join(df, state, ["k"], "w")
    assert joined.count() == df.count()
    assert joined.where("k = 'hot' and w = 1000").count() == 1000
    assert joined.where("k is null").count() == df.where("k is null").count()


def test_key_results_shares(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 3), ("b", "x", 3)], "f string, g string, i int")
    got = {(r["key_field"], r["key_value"]): (r["n_rows"], r["row_share"]) for r in heavy.key_results(df, ["f", "g"], {}, {}, ["i"]).collect()}
    assert got == {("f", "a"): (2, 0.5), ("f", "b"): (1, 0.25), ("f", None): (1, 0.25), ("g", "x"): (3, 0.75), ("g", None): (1, 0.25)}
    assert heavy.key_results(df.limit(0), ["f", "g"], {}, {}, ["i"]).count() == 0
