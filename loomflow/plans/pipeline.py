"""Queries of the data-processing operators over the job-history tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.operators import features, heavy, intervals, logs, packed
from loomflow.plans.pipeline_sql import P3_ENTRIES_SQL, P3_FOUND_SQL, P5_FOUND_SQL
from loomflow.sources.tables import table


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics behind the features, a row per dag and type that occurs."""
    e = table(spark, sf_dir, "vertex_events")
    stats = features.event_statistics(e, F.col("dag"), F.col("eventtype"), F.col("event_id"), F.col("event_time"), F.col("event_size"))
    return stats.withColumnRenamed("entity", "dag")


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_table(p2_stats(spark, sf_dir).withColumnRenamed("dag", "entity")).withColumnRenamed("entity", "dag")


def p2_feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table spread out again: a row per dag and type of the complete list, also of types that a dag lacks."""
    wide = p2_features(spark, sf_dir)
    cells = wide.select("dag", "n_events", "latest_ms", F.explode(F.arrays_zip("types", "counts", "last_ms", "sizes")).alias("c"))
    return cells.select("dag", "n_events", "latest_ms", F.col("c.types").alias("eventtype"), F.col("c.counts").alias("n_of_type"), F.col("c.last_ms").alias("last_ms"), F.col("c.sizes").alias("total_size"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = p2_features(spark, sf_dir)
    cells = wide.select("dag", "latest_ms", F.explode(F.arrays_zip("types", "counts", "last_ms")).alias("c"))
    return cells.where("c.counts >= 3 and latest_ms - c.last_ms <= 60000").select("dag", F.col("c.types").alias("eventtype"))


P2_EVENTS_SQL = """
with e as (
  select lower(regexp_replace(dag, '^\\s+|\\s+$', '', 'g')) as dag,
         regexp_replace(regexp_replace(upper(eventtype), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_|_$', '', 'g') as eventtype, event_id,
         case when event_time < 100000000000 then event_time * 1000 when event_time < 100000000000000 then event_time
              when event_time < 100000000000000000 then event_time // 1000 else event_time // 1000000 end as ms, event_size
  from vertex_events where event_time > 0),
d as (select dag, eventtype, event_id, max(ms) as ms, max(event_size) as size from e where dag <> '' and eventtype <> '' and event_id is not null group by 1, 2, 3),
s as (select dag, eventtype, count(*) as n_events, max(ms) as last_ms, cast(coalesce(sum(size), 0) as bigint) as total_size from d group by 1, 2)
"""

P2_STATS_SQL = P2_EVENTS_SQL + "select * from s"

P2_FEATURE_CELLS_SQL = P2_EVENTS_SQL + """, d2 as (select dag, cast(sum(n_events) as bigint) as n_events, max(last_ms) as latest_ms from s group by 1)
select d2.dag, d2.n_events, d2.latest_ms, t.eventtype, coalesce(s.n_events, 0) as n_of_type, s.last_ms, coalesce(s.total_size, 0) as total_size
from d2 cross join (select distinct eventtype from s) t left join s on s.dag = d2.dag and s.eventtype = t.eventtype
"""

P2_FOUND_SQL = P2_EVENTS_SQL + """
select dag, eventtype from (select *, max(last_ms) over (partition by dag) as latest from s) where n_events >= 3 and latest - last_ms <= 60000
"""


def p3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(table(spark, sf_dir, "am_log"), with_text=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(table(spark, sf_dir, "am_log")).drop("message")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = packed.unpack(table(spark, sf_dir, "am_raw_events"), "event_id", {"args": packed.argument_list(F.col("args"))})
    tables = {name: packed.table_list(F.col(name)) for name in ("tables_read", "tables_written")}
    return args.unionByName(packed.unpack(table(spark, sf_dir, "queries"), "entity_id", tables))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "attempts").where("start_time > 0 and end_time > 0")
    found = intervals.periods_and_gaps(a, "container_id", "start_time", "end_time")
    return found.withColumnsRenamed({"from_unit": "from_ms", "to_unit": "to_ms"})


P6_FOUND_SQL = """
with a as (select container_id as c, start_time as s, end_time as e from attempts where container_id is not null and start_time > 0 and end_time > 0 and end_time >= start_time),
m as (select *, max(e) over (partition by c order by s, e rows between unbounded preceding and 1 preceding) as upto from a),
i as (select *, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by c order by s, e) as k from m),
p as (select c, k, min(s) as s, max(e) as e from i group by 1, 2),
g as (select c, e, lead(s) over (partition by c order by s) as n from p)
select c as container_id, 'period' as kind, s as from_ms, e as to_ms from p
union all select c, 'gap', e, n from g where n is not null
"""


def p7_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vertex_name and per node_id: rows, distinct attempts, time taken, span."""
    a = table(spark, sf_dir, "attempts").select("vertex_name", "node_id", "task_attempt_id", "time_taken", "start_time", "status")
    taken = F.when(F.col("time_taken") >= 0, F.col("time_taken"))
    partial = {
        "taken_ms": F.sum(taken),
        "n_taken": F.count(taken),
        "longest_ms": F.max(taken),
        "first_start": F.min(F.when(F.col("start_time") > 0, F.col("start_time"))),
        "n_failed": F.count_if(F.col("status") == "FAILED"),
    }
    merge = {"taken_ms": F.sum, "n_taken": F.sum, "longest_ms": F.max, "first_start": F.min, "n_failed": F.sum}
    return heavy.key_results(a, ["vertex_name", "node_id"], partial, merge, ["task_attempt_id"], distinct={"n_attempts": "task_attempt_id"}, else_by=["start_time", "time_taken"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "attempts").select("vertex_name", "node_id", "task_attempt_id")
    found = heavy.key_results(a, ["vertex_name", "node_id"], {}, {}, salt_by=["task_attempt_id"])
    return found.where("key_value is not null and row_share >= 0.025").select("key_field", "key_value")


P7_KEYS_SQL = """
with a as (
  select 'vertex_name' as key_field, vertex_name as key_value, * from attempts
  union all select 'node_id', node_id, * from attempts)
"""

P7_RESULTS_SQL = P7_KEYS_SQL + """
select key_field, key_value, count(distinct task_attempt_id) as n_attempts, cast(sum(time_taken) filter (where time_taken >= 0) as bigint) as taken_ms,
  count(*) filter (where time_taken >= 0) as n_taken, max(time_taken) filter (where time_taken >= 0) as longest_ms,
  min(start_time) filter (where start_time > 0) as first_start, count(*) filter (where status = 'FAILED') as n_failed, count(*) as n_rows,
  count(*) / (select count(*) from attempts) as row_share
from a group by 1, 2
"""

P7_FOUND_SQL = P7_KEYS_SQL + """
select key_field, key_value from a where key_value is not null group by 1, 2 having count(*) >= 0.025 * (select count(*) from attempts)
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_stats": p2_stats, "p2_features": p2_features, "p2_feature_cells": p2_feature_cells, "p3_found": p3_found, "p3_entries": p3_entries, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_results": p7_results}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND_SQL, "p2_stats": P2_STATS_SQL, "p2_feature_cells": P2_FEATURE_CELLS_SQL, "p3_found": P3_FOUND_SQL, "p3_entries": P3_ENTRIES_SQL, "p5_found": P5_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_results": P7_RESULTS_SQL}
