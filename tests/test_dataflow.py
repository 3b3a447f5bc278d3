"""Semantic traps of the dataflow operators on tiny inputs, and the physical plans they should get."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomflow.functions import scalars, udfs
from loomflow.metrics import observed
from loomflow.operators import aggregates, cartesian, exchange, joins, sets, sorts, text
from loomflow.sources import splits


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_semi_and_intersect_differ_on_duplicates(spark, plan):
    left, right = keys(spark, "a", "a", "b", "c", None), keys(spark, "a", "a", "d", None)
    for broadcast in (False, True):
        joined = joins.hash_semi_join(left, right, ["k"], broadcast)
        assert [r.k for r in joined.collect()] == ["a", "a"]
        assert ("BroadcastHashJoin" if broadcast else "ShuffledHashJoin") in plan(joined)
    both = joins.intersect_keys(left, right, ["k"])
    assert [r.k for r in both.collect()] == ["a"] and "SortMergeJoin" in plan(both)


@pytest.mark.parametrize(("right", "valid"), [(["a", "b", "b"], True), (["a", "c"], False), ([], False)])
def test_validate(spark, right, valid):
    assert joins.validate_keys(keys(spark, "a", "b"), keys(spark, *right), ["k"]).first()["valid"] is valid
    assert joins.validate_keys(keys(spark), keys(spark), ["k"]).first()["valid"] is True


def test_tokens(spark):
    df = spark.createDataFrame([("a\tb  c\n",), ("A,a",), ("",), (" ",), (None,), ("v\x0bw\x0cz",)], "t string")
    assert sorted(r.word for r in text.tokenize(df, "t").collect()) == ["A,a", "a", "b", "c", "v\x0bw", "z"]


def test_word_count_fixture(spark):
    df = spark.createDataFrame([("\t".join(f"a_{i}" for i in range(1, 11) for _ in range(11 - i)),)] * 2, "t string")
    assert [(r.word, r.cnt) for r in text.ordered_word_count(df, "t").collect()] == [(f"a_{i}", 2 * (11 - i)) for i in range(10, 0, -1)]


def test_filter_lines_is_substring(spark):
    df = spark.createDataFrame([(1, "one\nsubwordless\n\nword"), (2, None)], "i int, t string")
    assert [tuple(r) for r in text.filter_lines(df, "t", "word", ["i"]).collect()] == [(1, 2, "subwordless"), (1, 4, "word")]


def test_unions(spark):
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("a", 3)]))
    total = [F.sum("v").alias("v")]
    assert sorted((r.k, r.v, r.src) for r in sets.union_concatenated([a, b], ["k"], total).collect()) == [("a", 1, 0), ("a", 3, 1), ("b", 2, 0)]
    assert sorted((r.k, r.v) for r in sets.union_merged([a, b], ["k"], total).collect()) == [("a", 4), ("b", 2)]
    words = keys(spark, "x", "y", "y")
    assert tuple(sets.union_check(words, words, words, "k").first()) == ("Union", 2, 0)
    assert tuple(sets.union_check(words, words, keys(spark, "x"), "k").first()) == ("Union", 2, 1)


def test_products(spark, plan):
    v1, v2, v3 = keys(spark, "x", "x", "y"), spark.createDataFrame([("p",), ("p",), ("q",)], "r string"), keys(spark, "x")
    assert sorted(map(tuple, cartesian.filtered_cross(v1, v2, v3, "k").collect())) == [("x", "p"), ("x", "p"), ("x", "q"), ("x", "q")]
    assert sorted(map(tuple, cartesian.distinct_cross(v1, v2).collect())) == [("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")]
    assert cartesian.fair_cartesian(v1, v2.limit(0)).count() == 0
    fair = cartesian.fair_cartesian(v1, v2)
    assert fair.count() == 9 and "CartesianProduct" in plan(fair)


def test_fair_chunks():
    assert cartesian.fair_chunks([1000, 0]) == [0, 0]
    assert cartesian.fair_chunks([10, 10]) == [1, 1]
    a, b = cartesian.fair_chunks([100_000, 400_000])
    assert a * b <= 1000 and 3 <= b / a <= 5
    assert cartesian.fair_chunks([10**9, 3])[1] == 1


def test_composite(spark):
    s1 = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c"), (None, "n")], "k string, v string")
    s2 = spark.createDataFrame([("k1", "z"), ("k3", "y")], "k string, v string")
    assert sorted(map(tuple, joins.composite_join([s1, s2], "k", "v", "inner").collect())) == [("k1", "a", "z"), ("k1", "b", "z")]
    assert sorted(map(str, map(tuple, joins.composite_join([s1, s2], "k", "v", "outer").collect()))) == ["('k1', 'a', 'z')", "('k1', 'b', 'z')", "('k2', 'c', None)", "('k3', None, 'y')"]
    assert sorted(map(tuple, joins.composite_join([s2, s1], "k", "v", "override").collect())) == [("k1", 1, "a"), ("k1", 1, "b"), ("k2", 1, "c"), ("k3", 0, "y")]
    with pytest.raises(ValueError):
        joins.composite_join([s1, s2], "k", "v", "left")


def test_secondary_sort_orders_negatives_and_keeps_duplicates(spark):
    df = spark.createDataFrame([(1, -5), (1, 3), (-2, 9), (1, 3)], "a int, b int")
    got = sorts.secondary_sort(df, "a", "b").select("a", "b", F.spark_partition_id().alias("p")).collect()
    assert [(r.b) for r in got if r.a == 1] == [-5, 3, 3] and len({r.p for r in got if r.a == 1}) == 1
    ranks = sorts.secondary_rank(df, "a", ["b"]).collect()
    assert sorted((r.a, r.b, r.rank_no) for r in ranks) == [(-2, 9, 1), (1, -5, 1), (1, 3, 2), (1, 3, 3)]


def test_total_sort_and_top_k(spark, plan):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = sorts.total_sort(df, ["v"], 5).select("v", F.spark_partition_id().alias("p")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.p)] == list(range(1000))
    assert [r.v for r in sorts.top_k(df, [F.col("v").desc()], 3).collect()] == [999, 998, 997]
    assert "TakeOrderedAndProject" in plan(sorts.top_k(df, [F.col("v").desc()], 3))


def test_routing(spark):
    df = spark.range(-50, 50)
    routed = exchange.route(df, exchange.modulo_id(F.col("id"), 3), 3).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.id % 3 for r in routed) and len(routed) == 100
    assert spark.range(1).select(exchange.first_key_id(F.lit(-3), 5)).first()[0] == 381 % 5
    assert spark.range(1).select(exchange.char_id(F.lit("")), exchange.char_id(F.lit("a"))).first()[:] == (None, 1)
    spread = exchange.scatter(df, ["id"], 4, sort=True)
    assert spread.rdd.getNumPartitions() == 4
    assert exchange.durable(df, "reliable").count() == 100
    small, is_small = exchange.broadcast_checked(df, 99)
    assert not is_small and small is df


def test_partition_counts_change_nothing(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("string").alias("k"))
    other = keys(spark, *[str(i) for i in range(0, 60, 3)])
    results = {tuple(sorted(r.k for r in joins.hash_semi_join(df.repartition(n), other.repartition(m), ["k"], b).collect())) for n, m, b in ((1, 7, True), (5, 2, False), (9, 1, True))}
    assert len(results) == 1


def test_groups(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z")], "k string, o int, v string")
    assert sorted(map(str, map(tuple, aggregates.first_per_group(df, ["k"], ["o"], ["v"]).collect()))) == ["('a', 'y')", "(None, 'z')"]
    assert [tuple(r) for r in aggregates.broadcast_sum(df, "o", keys(spark, "c")).collect()] == [("c", 8, 3)]
    assert [tuple(r) for r in joins.broadcast_one_to_one_sum(df.select("o"), df.limit(0), "o", "o", "t").orderBy("o").collect()] == [(1, 1), (2, 2), (5, 5)]
    total = aggregates.combine_and_reduce(df.select("k", "o"), ["k"], lambda p: p.groupby("k", as_index=False, dropna=False).sum(), "k string, o int")
    assert sorted(map(str, map(tuple, total.collect()))) == ["('a', 3)", "(None, 5)"]
    spread = udfs.group_aggregate(lambda s: float(s.max() - s.min()), "double")
    assert dict((r.k, r.d) for r in df.groupBy("k").agg(spread("o").alias("d")).collect()) == {"a": 1.0, None: 0.0}
    assert aggregates.map_batches(df.select("o"), lambda p: pd.DataFrame({"o": p["o"] + 1}), "o int").agg(F.sum("o")).first()[0] == 11


def test_observed(spark):
    df, seen = observed(spark.range(10), "rows", total=F.sum("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_rows": 10, "total": 45}


def test_split_groups():
    assert splits.group_count(0, 8) == 0
    assert splits.group_count(10 << 20, 8) == 1
    assert splits.group_count(100 << 30, 8) == 100
    assert splits.group_count(4 << 30, 16) == 27
    groups = splits.group_splits([(10, "a"), (10, "b"), (10, "a"), (10, "b"), (10, None)], 2)
    assert sorted(i for g in groups for i in g) == [0, 1, 2, 3, 4] and len(groups) == 2
    assert splits.group_splits([], 3) == []


def test_more_exchanges_and_hooks(spark):
    df = spark.range(100)
    assert exchange.round_robin(df, 5).rdd.getNumPartitions() == 5
    placed = exchange.by_range(df, ["id"], 4).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(a.id < b.id for a in placed for b in placed if a.p < b.p)
    with pytest.raises(ValueError):
        exchange.durable(df, "forever")
    assert udfs.processor(df, lambda parts: (p[p["id"] > 97] for p in parts), "id long").count() == 2
    span = aggregates.reduce_groups(df.selectExpr("id % 2 as g", "id"), ["g"], lambda p: pd.DataFrame({"g": p["g"][:1], "n": [len(p)]}), "g long, n long")
    assert sorted(map(tuple, span.collect())) == [(0, 50), (1, 50)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert splits.configure(spark, 4 << 30, slots=16) == 27
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_byte_order(spark):
    values = ["b", "a", "\u00e9", "Z", "a\u0000"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r.t for r in df.orderBy(sorts.byte_order("t")).collect()] == sorted(values, key=str.encode)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda v: F.lit(v).cast("long")
    assert one(scalars.whole_ms(F.lit("2024-01-01 00:00:00.123999").cast("timestamp"))) == 1_704_067_200_123
    assert one(scalars.post_data_ms(lit(10), lit(50), lit(30))) == 20
    assert one(scalars.post_data_ms(lit(10), lit(50), lit(None))) == 40
    assert one(scalars.post_data_ms(lit(0), lit(50), lit(30))) == one(scalars.post_data_ms(lit(None), lit(50), lit(30))) == -1
    assert one(scalars.locality_class(lit(None), lit(1), lit(1))) == "RACK_LOCAL"
    assert one(scalars.detailed_status(F.lit("KILLED"), F.lit("LOST"))) == "KILLED:LOST" and one(scalars.detailed_status(F.lit("KILLED"), F.lit(""))) == "KILLED"
    assert one(scalars.one_line(F.lit("a,b\nc"))) == "a b c" and one(scalars.ratio(lit(1), lit(0))) is None
    assert one(scalars.rounded(F.lit(2.675), 2)) == 2.68 and one(scalars.rounded(F.lit(-1.5), 0)) == -1.0


def test_combinations_not_kept_are_never_paired(spark, plan):
    a, b = spark.range(40).withColumnRenamed("id", "a"), spark.range(30).withColumnRenamed("id", "b")
    pids = [("p", exchange.modulo_id(F.col("a"), 5)), ("q", exchange.modulo_id(F.col("b"), 3))]
    got = cartesian.cartesian([a, b], pids, lambda p, q: p == q + 1)
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in range(40) for y in range(30) if x % 5 == y % 3 + 1}
    text = plan(got)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_one_writer_filters_in_parallel(spark, plan):
    df = spark.range(100, numPartitions=4).select(F.concat(F.lit("w x"), F.col("id")).alias("t"))
    out = text.filter_lines_to_one_writer(df, "t", "x1")
    assert "Coalesce" not in plan(out).split("== Physical Plan ==")[1]
    assert out.count() == 11
