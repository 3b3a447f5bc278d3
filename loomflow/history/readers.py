"""Readers and writers of job-history event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.sources.sinks import write_dated

#: One event: a flat record and free pairs.
EVENT_SCHEMA = (
    "event_type string, event_time long, user string, app_id string, app_attempt_id string, dag_id string, "
    "vertex_id string, task_id string, task_attempt_id string, event_data map<string,string>"
)

#: One line per finished entity, with its events nested.
ENTITY_SCHEMA = "entity string, entitytype string, starttime long, events array<struct<eventtype:string,timestamp:long>>, otherinfo map<string,string>, primaryfilters map<string,string>"


def read_events(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Events of a flat log, JSON lines or Parquet; lines that don't parse are left out."""
    if kind == "json":
        rows = spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").json(path)
        return rows.where("event_type is not null")
    return spark.read.format(kind).schema(EVENT_SCHEMA).load(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends events to folders by UTC day."""
    write_dated(events, path, "event_time")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(entity, entity_type, event_type, event_time, info) with a row per event of each entity line."""
    rows = spark.read.schema(ENTITY_SCHEMA).json(path).where("entity is not null")
    return rows.select("entity", F.col("entitytype").alias("entity_type"), F.explode_outer("events").alias("e"), F.col("otherinfo").alias("info")).select("entity", "entity_type", F.col("e.eventtype").alias("event_type"), F.col("e.timestamp").alias("event_time"), "info")


def attempts_from_events(events: DataFrame) -> DataFrame:
    """A row per task attempt from its flat start and finish events; later events win over earlier ones."""
    data = lambda k: F.try_element_at("event_data", F.lit(k))
    rows = events.where("task_attempt_id is not null")
    start, finish = F.col("event_type").endswith("STARTED"), F.col("event_type").endswith("FINISHED")
    latest = lambda k: F.max_by(data(k), F.when(data(k).isNotNull(), F.col("event_time"))).alias(k)
    out = rows.groupBy("task_attempt_id").agg(
        F.max("dag_id").alias("dag_id"), F.max("vertex_id").alias("vertex_id"), F.max("task_id").alias("task_id"),
        F.max(F.when(start, F.col("event_time"))).alias("start_time"), F.max(F.when(finish, F.col("event_time"))).alias("end_time"),
        *[latest(k) for k in ("vertex_name", "container_id", "node_id", "status", "termination_cause", "creation_causal_ta", "diagnostics")],
    )
    return out.withColumn("time_taken", F.col("end_time") - F.col("start_time"))


def counters_from_events(events: DataFrame, prefix: str = "counter.") -> DataFrame:
    """(entity_id, counter_group, counter_name, value) of pairs named ``counter.GROUP.NAME``."""
    pairs = events.select(F.coalesce("task_attempt_id", "task_id", "vertex_id", "dag_id", "app_id").alias("entity_id"), F.explode("event_data").alias("k", "v")).where(F.col("k").startswith(prefix))
    parts = F.split("k", r"\.", 3)
    return pairs.select("entity_id", parts[1].alias("counter_group"), parts[2].alias("counter_name"), F.col("v").try_cast("long").alias("value")).where("value is not null")


def write_nowhere(events: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    events.write.format("noop").mode("overwrite").save()
