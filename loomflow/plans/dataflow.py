"""Queries of the dataflow operators over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.operators import aggregates, cartesian, exchange, joins, sets, sorts, text
from loomflow.runtime import shared_path
from loomflow.sources import generators, sinks
from loomflow.sources.tables import table

TOKENS_SQL = "select {keys} unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) as word from documents"
LINE_SQL = "select doc_id, cast(generate_subscripts(parts, 1) as integer) as line_no, unnest(parts) as line from (select doc_id, string_split(text, chr(10)) as parts from documents)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201 - a decorator
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"select word, count(*) as cnt from ({TOKENS_SQL.format(keys='')}) where word <> '' group by 1")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_count(table(spark, sf_dir, "documents"), "text")


@query(f"select word, count(*) as cnt from ({TOKENS_SQL.format(keys='')}) where word <> '' group by 1 order by cnt, word")
def ordered_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ordered_word_count(table(spark, sf_dir, "documents"), "text")


@query(f"select lang, word, count(*) as cnt from ({TOKENS_SQL.format(keys='lang, ')}) where word <> '' group by 1, 2")
def session_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word count per language, as one grouped plan instead of a job each."""
    return text.word_count(table(spark, sf_dir, "documents"), "text", ["lang"])


@query(f"select doc_id, line_no, line from ({LINE_SQL}) where contains(line, 'ledger')")
def filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.filter_lines(table(spark, sf_dir, "documents"), "text", "ledger", ["doc_id"])


@query(f"select doc_id, line_no, line from ({LINE_SQL}) where contains(line, 'broker')")
def filter_lines_one_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.filter_lines_to_one_writer(table(spark, sf_dir, "documents"), "text", "broker", ["doc_id"])


@query("select l_orderkey, l_linenumber from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT')")
def hash_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.hash_semi_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), build, ["l_orderkey"])


@query("select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def hash_join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.hash_semi_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), build, ["o_custkey"], broadcast=True)


@query("select o_custkey as custkey from orders intersect select c_custkey from customer")
def sort_merge_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.intersect_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), ["custkey"])


@query("""with m as ((select o_custkey as k from orders except select c_custkey from customer) union all (select c_custkey from customer except select o_custkey from orders))
select count(*) as n_mismatch, count(*) = 0 as valid from m""")
def join_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.validate_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


def _keyed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")),
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v")),
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")),
    ]


@query("select c_custkey as k, c_mktsegment as value_0, o_orderpriority as value_1, s_name as value_2 from customer join orders on o_custkey = c_custkey join supplier on s_suppkey = c_custkey")
def composite_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.composite_join(_keyed(spark, sf_dir), "k", "v", "inner")


@query("""select coalesce(c_custkey, o_custkey, s_suppkey) as k, c_mktsegment as value_0, o_orderpriority as value_1, s_name as value_2
from customer full join orders on o_custkey = c_custkey full join supplier on s_suppkey = coalesce(c_custkey, o_custkey)""")
def composite_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.composite_join(_keyed(spark, sf_dir), "k", "v", "outer")


@query("""with u as (select c_custkey as k, 0 as source, c_mktsegment as value from customer union all select o_custkey, 1, o_orderpriority from orders union all select s_suppkey, 2, s_name from supplier)
select k, source, value from (select *, max(source) over (partition by k) as top from u) where source = top""")
def composite_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.composite_join(_keyed(spark, sf_dir), "k", "v", "override")


@query("select n_name, r_name from nation cross join (select distinct r_name from region) r where exists (select 1 from customer where c_nationkey = n_nationkey)")
def cartesian_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return cartesian.filtered_cross(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select("r_name"), keep, "n_nationkey").select("n_name", "r_name")


@query("select * from (select distinct n_regionkey from nation) a cross join (select distinct c_mktsegment from customer) b")
def cartesian_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cartesian.distinct_cross(table(spark, sf_dir, "nation").select("n_regionkey"), table(spark, sf_dir, "customer").select("c_mktsegment"))


@query("select n_nationkey, r_regionkey from nation cross join region where n_nationkey % 3 <= r_regionkey % 3")
def cartesian_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey")
    return cartesian.cartesian([a, b], [("pid_a", exchange.modulo_id(F.col("n_nationkey"), 3)), ("pid_b", exchange.modulo_id(F.col("r_regionkey"), 3))], lambda p, q: p <= q)


@query("select n_name, r_name, m.c_mktsegment from nation cross join region cross join (select distinct c_mktsegment from customer) m")
def cartesian_nary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cartesian.cartesian([table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "customer").select("c_mktsegment").distinct()])


@query("select s_suppkey, n_nationkey from supplier cross join nation")
def cartesian_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cartesian.fair_cartesian(table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "nation").select("n_nationkey"))


@query("select s_suppkey, cast(s_suppkey + (select sum(n_nationkey) from nation) as bigint) as total from supplier")
def broadcast_one_to_one_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, shared = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "nation").select("n_nationkey")
    return joins.broadcast_one_to_one_sum(own, shared, "s_suppkey", "n_nationkey", "total")


@query("select r_name, cast((select sum(n_nationkey) from nation) as bigint) as value_sum, (select count(n_nationkey) from nation) as value_count from region")
def broadcast_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.broadcast_sum(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "region").select("r_name"))


def _order_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return [orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O", "P")]


@query("select o_custkey, o_orderpriority, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as src from orders where o_orderstatus in ('F', 'O', 'P')")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_all(_order_parts(spark, sf_dir), "src")


@query("select o_orderpriority, count(*) as n, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as src from orders where o_orderstatus in ('F', 'O', 'P') group by 1, 3")
def union_concat_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_concatenated(_order_parts(spark, sf_dir), ["o_orderpriority"], [F.count(F.lit(1)).alias("n")])


@query("select o_orderpriority, count(*) as n from orders where o_orderstatus in ('F', 'O', 'P') group by 1")
def union_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_merged(_order_parts(spark, sf_dir), ["o_orderpriority"], [F.count(F.lit(1)).alias("n")])


@query(f"select 'Union' as label, count(distinct word) as n_keys, cast(0 as bigint) as n_wrong from ({TOKENS_SQL.format(keys='')}) where word <> ''")
def union_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokenize(table(spark, sf_dir, "documents"), "text")
    return sets.union_check(words, words, words, "word")


@query("""with a as (select o_custkey as k from orders), b as (select c_custkey as k from customer)
select k, 'left' as side from (select k from a except all select k from b) union all select k, 'right' from (select k from b except all select k from a)""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.symmetric_difference(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_linenumber) as integer) as rank_no from lineitem")
def secondary_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorts.secondary_rank(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", ["l_linenumber"])


@query("select l_orderkey, l_linenumber from lineitem order by 1, 2")
def total_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorts.total_sort(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber from lineitem")
def partition_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorts.partition_sort(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sorts.top_k(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 100)


@query("select o_orderstatus, count(*) as n, count(distinct o_custkey) as n_cust from orders group by 1")
def dynamic_partition_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes orders to a folder per status, and reads them back."""
    path = shared_path(spark, "dynamic")
    sinks.write_dynamic(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_cust"))


@query("select 'orders' as sink, count(*) as n from orders union all select 'customer', count(*) from customer union all select 'both', (select count(*) from orders) + (select count(*) from customer)")
def multi_sink_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sinks, one of them shared by two sources, that appear together."""
    paths = {n: shared_path(spark, f"sink-{n}") for n in ("orders", "customer", "both")}
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    sinks.write_all({paths["orders"]: a, paths["customer"]: b, paths["both"]: a.unionByName(b)})
    counts = [spark.read.parquet(path).agg(F.lit(n).alias("sink"), F.count(F.lit(1)).alias("n")) for n, path in paths.items()]
    return sets.union_all(counts)


@query("select distinct o_custkey from orders")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey").distinct()


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.first_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("select cast(abs(l_orderkey * 127) % 8 as integer) as pid, count(*) as n from lineitem group by 1")
def first_key_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed by |key x 127| mod 8: counts by the partition they arrive in."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return exchange.route(rows, exchange.first_key_id(F.col("l_orderkey"), 8), 8).groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(ascii(word) % 2 as integer) as pid, count(distinct word) as n from (" + TOKENS_SQL.format(keys="") + ") where word <> '' group by 1")
def char_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokenize(table(spark, sf_dir, "documents"), "text").distinct()
    return words.groupBy(exchange.char_id(F.col("word")).alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderpriority, count(*) as n, cast(sum(o_custkey) as bigint) as key_sum from orders group by 1")
def combine_and_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's combiner that runs per batch before the shuffle and per group after it."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.lit(1).cast("long").alias("n"), F.col("o_custkey").alias("key_sum"))
    return aggregates.combine_and_reduce(rows, ["o_orderpriority"], lambda p: p.groupby("o_orderpriority", as_index=False, dropna=False).sum(), "o_orderpriority string, n long, key_sum long")


@query("""with a as (select l_suppkey as k, count(*) as n from lineitem group by 1), b as (select n % 10 as k, sum(n) as n, count(*) as m from a group by 1)
select k, cast(n as bigint) as n, m from b""")
def multi_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map, two reduces in a row, and a narrow end: three stages."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy((F.col("n") % 10).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))


JOIN_DATA_SQL = """
with big as (select 'term_' || i || '_' || substr(md5('7:' || i), 1, 12) as value from range(0, 20000) t(i)),
small as (select 'term_' || i || '_' || substr(md5('7:' || i), 1, 12) as value from range(0, 4000) t(i)
          union all select 'term_' || i || '_' || substr(md5('7:' || i), 1, 12) from range(20000, 21000) t(i))
"""


@query(JOIN_DATA_SQL + "select value from big where value in (select value from small)")
def generated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection of a generated pair of inputs."""
    big, small, _ = generators.join_data(spark, 20_000, 5_000, 0.2, seed=7)
    return joins.intersect_keys(big, small, ["value"])


@query("select cast(0 as bigint) as n_mismatch, true as valid")
def generated_join_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    big, small, expected = generators.join_data(spark, 20_000, 5_000, 0.2, seed=7)
    return joins.validate_keys(joins.intersect_keys(big, small, ["value"]), expected, ["value"])


def _rows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").count()


_BIG = "select 'term_' || i || '_' || substr(md5('7:' || i), 1, 12) as value from (select unnest(range(0, n)) as i from (select count(*) as n from lineitem))"


@query(f"select value from ({_BIG}) where cast(split_part(value, '_', 2) as bigint) < (select least(cast(floor(count(*) * 0.2) as bigint), count(*) // 4) from lineitem)")
def generated_join_of_input_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``generated_join``, the large side of as many keys as ``lineitem`` has rows."""
    n = _rows(spark, sf_dir)
    big, small, _ = generators.join_data(spark, n, n // 4, 0.2, seed=7)
    return joins.intersect_keys(big, small, ["value"])


_LIST = "[" + ", ".join(f"'{w}'" for w in generators.WORDS) + "]"


@query(f"""with r as (select i, 20 + cast('0x' || substr(md5('3:2:' || i), 1, 8) as bigint) % 81 as n from (select unnest(range(0, (select count(*) // 10 from lineitem))) as i)),
w as (select i, unnest(range(1, n + 1)) as k from r)
select {_LIST}[1 + cast('0x' || substr(md5('3:2:' || i || ':' || k), 1, 8) as bigint) % {len(generators.WORDS)}] as word, count(*) as cnt from w group by 1""")
def random_text_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of generated sentences, one per ten rows of ``lineitem``."""
    return text.word_count(generators.random_text(spark, _rows(spark, sf_dir) // 10, seed=3), "value")


_STREAM = {"key": "substr(sha256('3k0:' || i), 1, 20)", "value": "substr(sha256('3v0:' || i) || sha256('3v1:' || i) || sha256('3v2:' || i), 1, 180)"}


@query(f"select row_number() over (order by {_STREAM['key']}) as position, {_STREAM['key']} as key, {_STREAM['value']} as value from (select unnest(range(0, (select count(*) from lineitem))) as i)")
def random_bytes_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated records in total order, as many as ``lineitem`` has rows, in hexadecimal, with where the sort put them."""
    ordered = sorts.with_positions(sorts.total_sort(generators.random_bytes(spark, _rows(spark, sf_dir), seed=3), ["key"]))
    return ordered.select("position", F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value"))


@query("select row_number() over (order by l_extendedprice, l_orderkey, l_linenumber) as position, l_extendedprice, l_orderkey, l_linenumber from lineitem")
def total_order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a total sort put each row: the order itself is compared."""
    keys = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    return sorts.with_positions(sorts.total_sort(table(spark, sf_dir, "lineitem").select(*keys), keys))


@query("select l_suppkey, count(*) as n, cast(0 as bigint) as n_misplaced, 1 as n_partitions from lineitem group by 1")
def partition_sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key of a partition sort: rows, rows that don't follow one another in order, and partitions it lies in."""
    from pyspark.sql.window import Window

    rows = sorts.partition_sort(table(spark, sf_dir, "lineitem").select("l_suppkey"), ["l_suppkey"]).withColumn("part", F.spark_partition_id())
    placed = sorts.with_positions(rows, "at")
    bounds = placed.groupBy("part", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    # A key's rows are one run, and runs follow one another by key.
    before = F.lag("high").over(Window.partitionBy("part").orderBy("l_suppkey"))
    runs = bounds.withColumn("off", F.col("high") - F.col("low") + 1 - F.col("n") + F.when(before + 1 != F.col("low"), 1).otherwise(0))
    return runs.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum("off").alias("n_misplaced"), F.count_distinct("part").cast("int").alias("n_partitions"))


@query("""select l_suppkey, l_partkey, separator, cast(row_number() over (partition by l_suppkey order by separator desc, l_partkey) as integer) as place from (
  select l_suppkey, l_partkey, false as separator from lineitem union all select distinct l_suppkey, null, true from lineitem)""")
def secondary_sort_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order with a separator row before each, and where each row lies in its group."""
    from pyspark.sql.window import Window

    rows = sorts.secondary_sort_separated(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")
    placed = sorts.with_positions(rows, "at")
    first = placed.groupBy("l_suppkey").agg(F.min("at").alias("low"))
    return placed.join(first, "l_suppkey").select("l_suppkey", "l_partkey", "separator", (F.col("at") - F.col("low") + 1).cast("int").alias("place"))


@query(f"""with w as (select doc_id, word from ({TOKENS_SQL.format(keys='doc_id, ')}) where word <> ''),
s as (select distinct word, 1 as n, 0 as src from w union all select distinct word, 1, 1 from w where doc_id % 2 = 0 union all select distinct word, -2, 2 from w where doc_id % 3 = 0)
select 'Union' as label, count(*) as n_keys, count(*) filter (where net <> 0) as n_wrong from (select word, sum(n) as net from s group by 1)""")
def union_check_of_different_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a union whose constituents differ, so that words don't net to 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [text.tokenize(d, "text") for d in (docs, docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"))]
    return sets.union_check(*parts, "word")


@query("select cast(ascii(word) % 2 as integer) as pid, count(*) as n from (" + TOKENS_SQL.format(keys="") + ") where word <> '' group by 1")
def char_partition_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words routed by their first character: counts by the partition they arrive in."""
    words = text.tokenize(table(spark, sf_dir, "documents"), "text")
    return exchange.route(words, exchange.char_id(F.col("word")), 2).groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query("""select c_name as line, cast(sum(octet_length(encode(c_name)) + 1) over (order by c_custkey rows between unbounded preceding and current row) - octet_length(encode(c_name)) - 1 as bigint) as "offset" from customer""")
def lines_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written as one text file, read back as lines with the byte each starts at, in ranges."""
    from loomflow.sources.text import read_lines_with_offsets

    path = shared_path(spark, "lines")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(1).sortWithinPartitions("c_custkey").select("c_name").write.text(path)
    return read_lines_with_offsets(spark, path).select("line", "offset")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
