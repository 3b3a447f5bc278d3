"""The relational job-history model: one row per attempt, and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text and time columns of which any filled value of an attempt's deliveries will do.
_TEXTS = ("task_id", "vertex_id", "dag_id", "vertex_name", "container_id", "node_id", "termination_cause", "creation_causal_ta", "diagnostics")
_TIMES = ("creation_time", "allocation_time", "start_time", "end_time", "time_taken", "execution_time_interval")


def attempt_facts(attempts: DataFrame) -> DataFrame:
    """One row per task_attempt_id from its deliveries: filled values win over nulls, a final
    status over RUNNING. Rows without an id are left out.

    Few rows are copies, so deliveries meet before any aggregation: aggregates of texts sort
    their input, and a partial one would sort everything once more for nothing.
    """
    attempts = attempts.where("task_attempt_id is not null").repartition("task_attempt_id")
    final = F.max(F.when(F.col("status") != "RUNNING", F.col("status")))
    status = F.coalesce(final, F.max("status")).alias("status")
    return attempts.groupBy("task_attempt_id").agg(*[F.max(c).alias(c) for c in (*_TEXTS, *_TIMES)], status)


ATTEMPT_FACTS_SQL = (
    "select task_attempt_id, "
    + ", ".join(f"max({c}) as {c}" for c in (*_TEXTS, *_TIMES))
    + ", coalesce(max(status) filter (where status <> 'RUNNING'), max(status)) as status from attempts where task_attempt_id is not null group by 1"
)

#: name -> (group, SQL over ``b``, an attempt's milliseconds, and ``i``, its task's number).
#: The tables have no counters; these are plain integer functions of what they have.
COUNTERS = {
    "SHUFFLE_BYTES": ("TaskCounter", "b * 40009"),
    "REDUCE_INPUT_RECORDS": ("TaskCounter", "b * 7 + i"),
    "REDUCE_INPUT_GROUPS": ("TaskCounter", "cast(floor((b * 7 + i) * (i % 10 + 1) / 20) as bigint)"),
    "MERGE_PHASE_TIME": ("TaskCounter", "cast(floor(b / 5) as bigint)"),
    "SHUFFLE_PHASE_TIME": ("TaskCounter", "cast(floor(b / 3) as bigint)"),
    "ADDITIONAL_SPILL_COUNT": ("TaskCounter", "i % 4"),
    "OUTPUT_BYTES": ("TaskCounter", "b * 131071"),
    "HDFS_BYTES_READ": ("FileSystemCounter", "b * 1009"),
    "DATA_LOCAL_TASKS": ("DAGCounter", "case when i % 5 < 2 then 1 end"),
    "RACK_LOCAL_TASKS": ("DAGCounter", "case when i % 5 between 2 and 3 then 1 end"),
    "OTHER_LOCAL_TASKS": ("DAGCounter", "case when i % 5 = 4 then 1 end"),
}

_BASE = "abs(coalesce(time_taken, 0)) as b, coalesce(cast(nullif({task}, '') as bigint), 0) as i"
WIDE_COUNTERS_SQL = (
    "select f.*, "
    + ", ".join(f"{e} as {n.lower()}" for n, (_, e) in COUNTERS.items())
    + " from (select *, "
    + _BASE.format(task="regexp_extract(task_id, '_(\\d+)$', 1)")
    + " from (" + ATTEMPT_FACTS_SQL + ") facts) f"
)
LONG_COUNTERS_SQL = "with w as (" + WIDE_COUNTERS_SQL + ") " + " union all ".join(
    f"select task_attempt_id as entity_id, '{g}' as counter_group, '{n}' as counter_name, {n.lower()} as value from w where {n.lower()} is not null" for n, (g, _) in COUNTERS.items()
)


def derived_counters(facts: DataFrame) -> DataFrame:
    """(entity_id, counter_group, counter_name, value) of each attempt; absent counters have no row."""
    base = facts.selectExpr("task_attempt_id as entity_id", *_BASE.format(task="regexp_extract(task_id, '_([0-9]+)$', 1)").replace(" as b, ", " as b|").split("|"))
    pairs = F.array(*[F.struct(F.lit(g).alias("counter_group"), F.lit(n).alias("counter_name"), F.expr(e).cast("long").alias("value")) for n, (g, e) in COUNTERS.items()])
    return base.select("entity_id", F.explode(pairs).alias("c")).select("entity_id", "c.*").where("value is not null")


#: name -> SQL of a counter of one input of an attempt, over ``b`` and ``i`` as above and ``k``, the input's number.
SOURCE_COUNTERS = {
    "REDUCE_INPUT_RECORDS": "b * (5 + k) + i",
    "REDUCE_INPUT_GROUPS": "cast(floor((b * (5 + k) + i) * ((i + 3 * k) % 10 + 1) / 20) as bigint)",
    "SHUFFLE_BYTES": "b * 40009 * (k + 1)",
    "SHUFFLE_BYTES_DISK_DIRECT": "b * 101 * k",
    "MERGE_PHASE_TIME": "cast(floor(b * (3 - k) / 4) as bigint)",
    "SHUFFLE_PHASE_TIME": "cast(floor(b / (k + 3)) as bigint)",
    "FIRST_EVENT_RECEIVED": "i + k",
    "LAST_EVENT_RECEIVED": "i + k + cast(floor(b / 7) as bigint)",
}
#: Counters of whole attempts that the report of nodes has beside time.
NODE_COUNTERS = {
    "HDFS_BYTES_READ": ("FileSystemCounter", "b * 1009"),
    "HDFS_BYTES_WRITTEN": ("FileSystemCounter", "b * 503 + i"),
    "FILE_BYTES_READ": ("FileSystemCounter", "b * 2003"),
    "FILE_BYTES_WRITTEN": ("FileSystemCounter", "case when i % 3 > 0 then b * 997 end"),
    "GC_TIME_MILLIS": ("TaskCounter", "cast(floor(b / 50) as bigint)"),
    "CPU_MILLISECONDS": ("TaskCounter", "cast(floor(b * 3 / 4) as bigint)"),
}
_SOURCES = ("source_0", "source_1")
SOURCE_COUNTERS_SQL = " union all ".join(
    f"select f.*, 'TaskCounter_' || vertex_name || '_INPUT_{name}' as counter_group, " + ", ".join(f"{e.replace('k', str(k))} as {n.lower()}" for n, e in SOURCE_COUNTERS.items())
    + " from (select *, " + _BASE.format(task="regexp_extract(task_id, '_(\\d+)$', 1)") + f" from f where vertex_name is not null) f"
    for k, name in enumerate(_SOURCES)
)
NODE_COUNTERS_SQL = (
    "select f.*, " + ", ".join(f"{e} as {n.lower()}" for n, (_, e) in NODE_COUNTERS.items()) + " from (select *, " + _BASE.format(task="regexp_extract(task_id, '_(\\d+)$', 1)") + " from f) f"
)


def _numbered(facts: DataFrame) -> DataFrame:
    return facts.selectExpr("task_attempt_id as entity_id", "vertex_name", *_BASE.format(task="regexp_extract(task_id, '_([0-9]+)$', 1)").replace(" as b, ", " as b|").split("|"))


def source_counters(facts: DataFrame) -> DataFrame:
    """(entity_id, counter_group, counter_name, value) with a group per input of each attempt."""
    base = _numbered(facts).where("vertex_name is not null")
    groups = [(F.concat(F.lit("TaskCounter_"), F.col("vertex_name"), F.lit(f"_INPUT_{name}")), k) for k, name in enumerate(_SOURCES)]
    cells = F.array(*[F.struct(g.alias("counter_group"), F.lit(n).alias("counter_name"), F.expr(e.replace("k", str(k))).cast("long").alias("value")) for g, k in groups for n, e in SOURCE_COUNTERS.items()])
    return base.select("entity_id", F.inline(cells)).where("value is not null")


def node_counters(facts: DataFrame) -> DataFrame:
    """(entity_id, counter_group, counter_name, value) of the counters that a report of nodes has."""
    cells = F.array(*[F.struct(F.lit(g).alias("counter_group"), F.lit(n).alias("counter_name"), F.expr(e).cast("long").alias("value")) for n, (g, e) in NODE_COUNTERS.items()])
    return _numbered(facts).select("entity_id", F.inline(cells)).where("value is not null")


def by_source(facts: DataFrame, counters: DataFrame, names: list[str]) -> DataFrame:
    """Attempts with ``counter_group`` and a column per named counter, a row for each group an attempt has."""
    cells = [F.max(F.when(F.col("counter_name") == n, F.col("value"))).alias(n.lower()) for n in names]
    wide = counters.where(F.col("counter_name").isin(names)).groupBy("entity_id", "counter_group").agg(*cells)
    return facts.join(wide, facts["task_attempt_id"] == wide["entity_id"]).drop("entity_id")


def last_data(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex_id, ``data_ta``, ``data_ms``): the last attempt to succeed of a vertex's sources, and when: its last data event."""
    done = facts.where("status = 'SUCCEEDED' and end_time > 0").groupBy("vertex_id").agg(F.max(F.struct("end_time", "task_attempt_id")).alias("end"))
    fed = edges.select(F.col("source_vertex").alias("vertex_id"), "destination_vertex").join(done, "vertex_id").groupBy("destination_vertex").agg(F.max("end").alias("end"))
    return fed.select(F.col("destination_vertex").alias("vertex_id"), F.col("end.task_attempt_id").alias("data_ta"), F.col("end.end_time").alias("data_ms"))


def data_events(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex_id, source_ta, at_ms): per edge the last attempt of its source vertex to succeed, as the data event that
    its destination waits for. The tables have no data events."""
    done = facts.where("status = 'SUCCEEDED' and end_time > 0").groupBy("vertex_id").agg(F.max(F.struct("end_time", "task_attempt_id")).alias("end"))
    fed = edges.select(F.col("source_vertex").alias("vertex_id"), "destination_vertex").join(done, "vertex_id")
    return fed.select(F.col("destination_vertex").alias("vertex_id"), F.col("end.task_attempt_id").alias("source_ta"), F.col("end.end_time").alias("at_ms")).distinct()


def with_counters(facts: DataFrame, counters: DataFrame, names: list[str]) -> DataFrame:
    """Attempts with a column per named counter (null where absent)."""
    wide = counters.where(F.col("counter_name").isin(names)).groupBy("entity_id").agg(*[F.max(F.when(F.col("counter_name") == n, F.col("value"))).alias(n.lower()) for n in names])
    return facts.join(wide, facts["task_attempt_id"] == wide["entity_id"], "left").drop("entity_id")


def vertex_facts(vertices: DataFrame) -> DataFrame:
    """One row per vertex_id from its deliveries."""
    rest = [c for c in vertices.columns if c != "vertex_id"]
    return vertices.where("vertex_id is not null").groupBy("vertex_id").agg(*[F.max(c).alias(c) for c in rest])


def dag_facts(dags: DataFrame) -> DataFrame:
    rest = [c for c in dags.columns if c != "dag_id"]
    return dags.where("dag_id is not null").groupBy("dag_id").agg(*[F.max(c).alias(c) for c in rest])


def chain_edges(vertices: DataFrame, skip: int = 1) -> DataFrame:
    """(dag_id, source_vertex, destination_vertex, movement) of the order of a dag's vertices: the tables
    have no edges. Vertices of equal task numbers are joined one to one, others scatter."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("dag_id").orderBy("vertex_id")
    ahead = vertices.select("dag_id", "vertex_id", "num_tasks", F.lead("vertex_id", skip).over(order).alias("to"), F.lead("num_tasks", skip).over(order).alias("to_tasks"))
    kind = F.when(F.col("num_tasks") == F.col("to_tasks"), "ONE_TO_ONE").otherwise("SCATTER_GATHER")
    return ahead.where("dag_id is not null and to is not null").select("dag_id", F.col("vertex_id").alias("source_vertex"), F.col("to").alias("destination_vertex"), kind.alias("movement"))
