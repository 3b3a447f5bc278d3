"""Extensions beyond parity: event-time windows, cubes and approximate counts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions.udfs import SplitWords
from loomflow.sources.tables import table
from loomflow.streaming import windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_time(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "ts")


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(_events(spark, sf_dir), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], "30 minutes").select(F.unix_seconds("window_start").alias("window_start"), "n")


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sessions(_events(spark, sf_dir), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return found.select("user_id", F.unix_micros("window_start").alias("first_us"), "n")


def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("n_orders"))


def approximate_distinct_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of orders, and whether the approximate one is within three standard errors of 2 percent."""
    found = table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.approx_count_distinct("l_orderkey", 0.02).alias("n"))
    return found.select("n_orders", (F.abs(F.col("n") - F.col("n_orders")) <= 0.06 * F.col("n_orders")).alias("within_bound"))


def table_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by a user-defined table function joined laterally."""
    docs = table(spark, sf_dir, "documents").select("text")
    return docs.lateralJoin(SplitWords(F.col("text").outer())).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


SQL = {
    "tumbling_window": "select epoch_us(time_bucket(interval '1 hour', ts)) // 1000000 as window_start, event_type, count(*) as n from events group by 1, 2",
    "sliding_window": """select w as window_start, count(*) as n from (
  select (epoch_us(ts) // 1800000000) * 1800 as w from events union all select (epoch_us(ts) // 1800000000) * 1800 - 1800 from events) group by 1""",
    "session_window": """select user_id, min(t) as first_us, count(*) as n from (
  select *, sum(new) over (partition by user_id order by t, event_id) as k from (
    select user_id, event_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 21600000000 then 0 else 1 end as new from events)) group by user_id, k""",
    "cube_counts": "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus, o_orderpriority) as integer) as level from orders group by cube (o_orderstatus, o_orderpriority)",
    "rollup_counts": "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus, o_orderpriority) as integer) as level from orders group by rollup (o_orderstatus, o_orderpriority)",
    "approximate_distinct_within_bound": "select count(distinct l_orderkey) as n_orders, true as within_bound from lineitem",
    "table_function_words": "select word, count(*) as cnt from (select unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) as word from documents) where word <> '' group by 1",
}


def queries() -> dict:
    return {f.__name__: f for f in (tumbling_window, sliding_window, session_window, cube_counts, rollup_counts, approximate_distinct, approximate_distinct_within_bound, table_function_words)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
