"""Job-history analyzers: each takes history tables and thresholds and gives rows for all dags at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.functions.scalars import detailed_status, one_line, or_zero, post_data_ms, ratio, rounded
from loomflow.history.model import by_source, last_data, with_counters
from loomflow.operators.running import previous, running_sum
from loomflow.operators.skew import hot_join
from loomflow.runtime import materialize, ship

#: The defaults of the thresholds below are fixed values: findings have to be the ones that users know
#: (900 MiB of shuffle; ratios 0.2, 0.4 and 0.6; 10,000 records; half of the time; 1.25 times the mean; 100 s; 1 GiB of output).
MIB = 1 << 20
_SHARES = (0.5, 0.75, 0.95, 0.98, 0.99)


def container_reuse(facts: DataFrame) -> DataFrame:
    """Attempts per vertex and container."""
    return facts.where("container_id is not null").groupBy("dag_id", "vertex_name", "container_id").agg(F.count(F.lit(1)).alias("n_attempts"))


def locality(facts: DataFrame, counters: DataFrame, least: float = 0.5) -> DataFrame:
    """Per vertex the shares of data-, rack- and other-local attempts, their mean run time and
    HDFS bytes, and ``poor``: fewer than ``least`` are data-local."""
    names = ["DATA_LOCAL_TASKS", "RACK_LOCAL_TASKS", "OTHER_LOCAL_TASKS", "HDFS_BYTES_READ"]
    rows = with_counters(facts, counters, names)
    kind = F.when(F.col("data_local_tasks").isNotNull(), "data").when(F.col("rack_local_tasks").isNotNull(), "rack").when(F.col("other_local_tasks").isNotNull(), "other")
    rows = rows.withColumn("kind", kind)
    aggs = [F.count(F.lit(1)).alias("n_attempts")]
    for k in ("data", "rack", "other"):
        mine = F.col("kind") == k
        aggs += [
            rounded(F.count_if(mine) / F.count(F.lit(1)), 6).alias(f"{k}_share"),
            rounded(F.avg(F.when(mine, F.col("time_taken"))), 2).alias(f"{k}_ms"),
            rounded(F.avg(F.when(mine, F.col("hdfs_bytes_read"))), 2).alias(f"{k}_bytes"),
        ]
    return rows.groupBy("dag_id", "vertex_name").agg(*aggs).withColumn("poor", F.col("data_share") < least)


def shuffle_time(facts: DataFrame, counters: DataFrame, most_share: float = 0.5, least_records: int = 10_000) -> DataFrame:
    """Per attempt with shuffled records: groups to records, merge and shuffle time, the share of
    real work, and ``slow``: less than ``most_share`` of the time of many records is work."""
    rows = with_counters(facts, counters, ["REDUCE_INPUT_RECORDS", "REDUCE_INPUT_GROUPS", "MERGE_PHASE_TIME", "SHUFFLE_PHASE_TIME"]).where("reduce_input_records > 0")
    work = F.col("time_taken") - or_zero(F.col("shuffle_phase_time")) - or_zero(F.col("merge_phase_time"))
    return rows.select(
        "dag_id", "vertex_name", "task_attempt_id", "reduce_input_records", "merge_phase_time", "shuffle_phase_time",
        rounded(ratio(F.col("reduce_input_groups"), F.col("reduce_input_records")), 6).alias("groups_share"),
        rounded(ratio(work, F.col("time_taken")), 6).alias("work_share"),
    ).withColumn("slow", (F.col("work_share") < most_share) & (F.col("reduce_input_records") > least_records))


def skew(facts: DataFrame, counters: DataFrame, shuffle_bytes: int = 900 * MIB) -> DataFrame:
    """Attempts with a finding: ``partitioning`` (large shuffle, few groups to records), ``skew``
    (more than 0.4 or 0.6 of the vertex's records), ``parallelism`` (large shuffle, ratio 0.2 to 0.4)."""
    rows = with_counters(facts, counters, ["SHUFFLE_BYTES", "REDUCE_INPUT_RECORDS", "REDUCE_INPUT_GROUPS"])
    totals = rows.groupBy("dag_id", "vertex_name").agg(F.sum("reduce_input_records").alias("vertex_records"), F.count(F.lit(1)).alias("n"))
    # a vertex may hold a third of all attempts: its total is an aggregate, not a window
    pairs = (rows["dag_id"].eqNullSafe(totals["dag_id"])) & (rows["vertex_name"].eqNullSafe(totals["vertex_name"]))
    rows = rows.join(totals, pairs).drop(totals["dag_id"]).drop(totals["vertex_name"])
    groups = ratio(F.col("reduce_input_groups"), F.col("reduce_input_records"))
    part = ratio(F.col("reduce_input_records"), F.col("vertex_records"))
    large = F.col("shuffle_bytes") > shuffle_bytes
    found = F.filter(
        F.array(
            F.when(large & (groups < 0.2), "partitioning"),
            F.when((F.col("n") > 1) & (part > 0.6), "skew above 0.6").when((F.col("n") > 1) & (part > 0.4), "skew above 0.4"),
            F.when(large & (groups > 0.2) & (groups < 0.4), "parallelism"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("dag_id", "vertex_name", "task_attempt_id", "shuffle_bytes", rounded(groups, 6).alias("groups_share"), rounded(part, 6).alias("records_share"), F.explode(found).alias("finding"))


def shuffle_time_by_source(facts: DataFrame, counters: DataFrame, least_work: float = 0.5, least_records: int = 10_000) -> DataFrame:
    """Per attempt and source (counter group) of more than ``least_records`` records: groups to records, bytes, event, merge
    and shuffle times, the work left without the merge, and ``slow``: it is less than ``least_work`` of the time."""
    names = ["REDUCE_INPUT_GROUPS", "REDUCE_INPUT_RECORDS", "SHUFFLE_BYTES", "SHUFFLE_BYTES_DISK_DIRECT", "MERGE_PHASE_TIME", "SHUFFLE_PHASE_TIME", "FIRST_EVENT_RECEIVED", "LAST_EVENT_RECEIVED"]
    rows = by_source(facts.select("dag_id", "vertex_name", "task_attempt_id", "node_id", "time_taken"), counters, names)
    rows = rows.where(F.col("reduce_input_records") > least_records).where("reduce_input_groups > 0")
    work = F.col("time_taken") - F.col("merge_phase_time")
    return rows.select(
        "*", rounded(ratio(F.col("reduce_input_groups"), F.col("reduce_input_records")), 6).alias("groups_share"), work.alias("work_ms"),
        (F.col("last_event_received") - F.col("first_event_received")).alias("events_ms"), (ratio(work, F.col("time_taken")) < least_work).alias("slow"),
    )


def skew_by_source(facts: DataFrame, counters: DataFrame, shuffle_bytes: int = 900 * MIB) -> DataFrame:
    """``skew`` for each source (counter group) by itself: an attempt's records are compared with those that all
    attempts of its vertex have of the same source."""
    rows = by_source(facts.select("dag_id", "vertex_name", "task_attempt_id"), counters, ["SHUFFLE_BYTES", "REDUCE_INPUT_RECORDS", "REDUCE_INPUT_GROUPS"])
    rows = materialize(rows, "skew-sources")
    keys = ["dag_id", "vertex_name", "counter_group"]
    totals = rows.groupBy(*keys).agg(F.sum("reduce_input_records").alias("source_records"), F.count(F.lit(1)).alias("n"))
    rows = hot_join(rows, totals, keys, "n")
    groups, part = ratio(F.col("reduce_input_groups"), F.col("reduce_input_records")), ratio(F.col("reduce_input_records"), F.col("source_records"))
    large = F.col("shuffle_bytes") > shuffle_bytes
    found = F.array_compact(F.array(
        F.when(large & (groups < 0.2), "partitioning"),
        F.when((F.col("n") > 1) & (part > 0.6), "skew above 0.6").when((F.col("n") > 1) & (part > 0.4), "skew above 0.4"),
        F.when(large & (groups > 0.2) & (groups < 0.4), "parallelism"),
    ))
    return rows.select(*keys, "task_attempt_id", "shuffle_bytes", rounded(groups, 6).alias("groups_share"), rounded(part, 6).alias("records_share"), F.explode(found).alias("finding"))


def slow_hosts(facts: DataFrame, counters: DataFrame) -> DataFrame:
    """Per host (a node without its port): attempts by status, their mean times (0 for none) and six mean counters."""
    names = ["HDFS_BYTES_READ", "HDFS_BYTES_WRITTEN", "FILE_BYTES_READ", "FILE_BYTES_WRITTEN", "GC_TIME_MILLIS", "CPU_MILLISECONDS"]
    rows = with_counters(facts.where("node_id is not null").withColumn("host", F.split("node_id", ":")[0]), counters, names)
    aggs = [F.count(F.lit(1)).alias("n_attempts")]
    for s in ("SUCCEEDED", "FAILED", "KILLED"):
        mine = F.col("status") == s
        aggs += [F.count_if(mine).alias(f"n_{s.lower()}"), F.coalesce(rounded(F.avg(F.when(mine, F.col("time_taken"))), 2), F.lit(0.0)).alias(f"{s.lower()}_ms")]
    aggs += [F.coalesce(rounded(F.avg(n.lower()), 2), F.lit(0.0)).alias(f"mean_{n.lower()}") for n in names]
    return rows.groupBy("host").agg(*aggs)


def slowest_vertex(facts: DataFrame, counters: DataFrame, slow_ms: int = 100_000, exact: bool = True) -> DataFrame:
    """Per vertex: makespan, longest shuffle, percentiles of attempt times, and a ``finding``.

    Exact percentiles hold a vertex's distinct times in one task; without ``exact`` they come from
    mergeable summaries of bounded size, with a rank error of at most 1 in 10,000.
    """
    rows = with_counters(facts.where("start_time > 0 and end_time >= start_time"), counters, ["SHUFFLE_PHASE_TIME"])
    shares = F.array(*[F.lit(q) for q in _SHARES])
    out = rows.groupBy("dag_id", "vertex_name").agg(
        (F.max("end_time") - F.min("start_time")).alias("makespan_ms"),
        F.max(or_zero(F.col("shuffle_phase_time"))).alias("shuffle_max_ms"),
        F.max("end_time").alias("last_end"),
        (F.percentile("time_taken", shares) if exact else F.percentile_approx("time_taken", list(_SHARES), 10_000)).alias("p"),
    )
    p = [rounded(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p75", "p95", "p98", "p99"))]
    out = out.select("dag_id", "vertex_name", "makespan_ms", "shuffle_max_ms", "last_end", *p)
    finding = (
        F.when(ratio(F.col("p75"), F.col("p99")) < 0.5, "straggler")
        .when(ratio(F.col("shuffle_max_ms"), F.col("makespan_ms")) > 0.5, "shuffle or late parent")
        .when(F.col("makespan_ms") > slow_ms, "slow vertex")
    )
    return out.withColumn("finding", finding)


def slow_nodes(facts: DataFrame, counters: DataFrame) -> DataFrame:
    """Per node: attempts by status, their mean times (0 for none) and mean counters."""
    rows = with_counters(facts.where("node_id is not null"), counters, ["HDFS_BYTES_READ", "SHUFFLE_BYTES"])
    aggs = [F.count(F.lit(1)).alias("n_attempts")]
    for s in ("SUCCEEDED", "FAILED", "KILLED"):
        mine = F.col("status") == s
        aggs += [F.count_if(mine).alias(f"n_{s.lower()}"), F.coalesce(rounded(F.avg(F.when(mine, F.col("time_taken"))), 2), F.lit(0.0)).alias(f"{s.lower()}_ms")]
    aggs += [rounded(F.avg(c), 2).alias(f"mean_{c}") for c in ("hdfs_bytes_read", "shuffle_bytes")]
    return rows.groupBy("node_id").agg(*aggs)


def slow_tasks(facts: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` attempts of the longest time; exactly k, ties by id."""
    return facts.where("time_taken is not null").orderBy(F.col("time_taken").desc(), "task_attempt_id").limit(k).select("task_attempt_id", "dag_id", "vertex_name", "time_taken", "status")


def spill(facts: DataFrame, counters: DataFrame, output_bytes: int = 1 << 30, spills: int = 1) -> DataFrame:
    """Attempts that spilled more than ``spills`` times and wrote more than ``output_bytes``."""
    rows = with_counters(facts, counters, ["ADDITIONAL_SPILL_COUNT", "OUTPUT_BYTES"])
    hit = (F.col("additional_spill_count") > spills) & (F.col("output_bytes") > output_bytes)
    return rows.where(hit).select("dag_id", "vertex_name", "task_attempt_id", "additional_spill_count", "output_bytes")


def task_assignment(facts: DataFrame) -> DataFrame:
    """Attempts per node and their load in percent of the mean over nodes."""
    per = facts.where("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("n_attempts"))
    mean = per.agg(F.avg("n_attempts")).scalar()
    return per.withColumn("load_percent", rounded(F.col("n_attempts") * 100 / mean, 2))


def result_statistics(facts: DataFrame) -> DataFrame:
    """Attempts by vertex, node and detailed status."""
    return facts.groupBy("vertex_name", "node_id", detailed_status(F.col("status"), F.col("termination_cause")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_attempts"))


def input_read_errors(facts: DataFrame) -> DataFrame:
    """Attempts ended by a lost input, output or node, newest first."""
    rows = facts.where(F.col("termination_cause").isin("INPUT_READ_ERROR", "OUTPUT_LOST", "NODE_FAILED"))
    return rows.select("dag_id", "vertex_name", "task_attempt_id", "termination_cause", "end_time", "node_id", one_line(F.col("diagnostics")).alias("diagnostics")).orderBy(F.col("end_time").desc_nulls_last(), "task_attempt_id")


def task_concurrency(facts: DataFrame) -> DataFrame:
    """(dag_id, vertex_id, at_ms, kind, running): attempts running after each distinct (time, START or
    FINISH) of a vertex; at equal times starts come before finishes.

    Steps are summed per vertex and event first; the running sum is over a vertex's own
    distinct event times.
    """
    rows = facts.where("start_time > 0 and end_time >= start_time and vertex_id is not null")
    steps = rows.select("dag_id", "vertex_id", F.explode(F.array(F.struct(F.col("start_time").alias("at_ms"), F.lit("START").alias("kind"), F.lit(0).alias("o"), F.lit(1).alias("d")), F.struct(F.col("end_time").alias("at_ms"), F.lit("FINISH").alias("kind"), F.lit(1).alias("o"), F.lit(-1).alias("d")))).alias("e")).select("dag_id", "vertex_id", "e.*")
    summed = materialize(steps.groupBy("dag_id", "vertex_id", "at_ms", "kind", "o").agg(F.sum("d").alias("d")), "concurrency-steps")  # read for the largest vertex too
    return running_sum(summed, ["dag_id", "vertex_id"], ["at_ms", "o"], F.col("d"), "running").select("dag_id", "vertex_id", "at_ms", "kind", "running")


def one_to_one_edges(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks joined one to one whose last attempts ran on different nodes."""
    number = F.regexp_extract("task_id", r"_(\d+)$", 1).cast("long")
    done = facts.where("status = 'SUCCEEDED' and node_id is not null and task_id is not null")
    last = done.groupBy("vertex_id", number.alias("task_no")).agg(F.max_by("node_id", F.struct("end_time", "task_attempt_id")).alias("node"))
    src, dst = last.select(F.col("vertex_id").alias("source_vertex"), "task_no", F.col("node").alias("source_node")), last.select(F.col("vertex_id").alias("destination_vertex"), "task_no", F.col("node").alias("destination_node"))
    pairs = edges.where("movement = 'ONE_TO_ONE'").join(src, "source_vertex").join(dst, ["destination_vertex", "task_no"])
    return pairs.where("source_node <> destination_node").select("dag_id", "source_vertex", "destination_vertex", "task_no", "source_node", "destination_node")


def dag_overview(dags: DataFrame, vertices: DataFrame, facts: DataFrame) -> DataFrame:
    """Life of each dag by time: events of the dag, of its vertices, and its failed attempts."""
    def event(df: DataFrame, entity: str, name: str, time: str, diagnostics: str | None = None) -> DataFrame:
        text = one_line(F.col(diagnostics)) if diagnostics else F.lit(None).cast("string")
        return df.where(F.col(time) > 0).select("dag_id", F.col(entity).alias("entity"), F.lit(name).alias("event"), F.col(time).alias("at_ms"), text.alias("diagnostics"))

    parts = [event(dags, "dag_id", n, c, d) for n, c, d in (("DAG_SUBMITTED", "submit_time", None), ("DAG_STARTED", "start_time", None), ("DAG_FINISHED", "end_time", "diagnostics"))]
    parts += [event(vertices, "vertex_id", n, c, d) for n, c, d in (("VERTEX_INITIALIZED", "init_time", None), ("VERTEX_STARTED", "start_time", None), ("VERTEX_FINISHED", "finish_time", "diagnostics"))]
    parts.append(event(facts.where("status = 'FAILED'"), "task_attempt_id", "ATTEMPT_FAILED", "end_time", "diagnostics"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("dag_id is not null").orderBy("dag_id", "at_ms", "event", "entity")


def dag_failures(vertices: DataFrame, facts: DataFrame) -> DataFrame:
    """The failures of each dag, with the task numbers of their vertex: vertices with a failed attempt (the one of the least
    id), tasks whose last attempt failed, and the failed attempts of these tasks: (dag_id, ``entity``, ``event``, ``at_ms``,
    ``num_tasks``, ``failed_tasks``, ``completed_tasks``, ``diagnostics``)."""
    stats = vertices.select(F.col("vertex_id").alias("v"), F.col("finish_time"), "num_tasks", "failed_tasks", "completed_tasks")
    failed = facts.where("status = 'FAILED' and vertex_id is not null and dag_id is not null")
    text = one_line(F.coalesce("diagnostics", F.lit("")))
    first = failed.groupBy("dag_id", "vertex_id").agg(F.min_by(F.struct("task_attempt_id", text.alias("text")), "task_attempt_id").alias("a"))
    of_vertices = first.join(stats, F.col("vertex_id") == F.col("v")).select("dag_id", F.col("vertex_id").alias("entity"), F.lit("VERTEX_FINISHED").alias("event"), F.col("finish_time").alias("at_ms"), "num_tasks", "failed_tasks", "completed_tasks", F.concat("a.task_attempt_id", F.lit(": "), "a.text").alias("diagnostics"))
    number = F.regexp_extract("task_attempt_id", r"_(\d+)$", 1).try_cast("long")
    last = facts.where("task_id is not null").groupBy("task_id").agg(F.max_by(F.struct("dag_id", "vertex_id", "status", "end_time", text.alias("text")), F.struct(number, "task_attempt_id")).alias("last"))
    tasks = materialize(last.where("last.status = 'FAILED' and last.dag_id is not null").select("task_id", "last.*"), "failed-tasks")
    of_tasks = tasks.join(stats, F.col("vertex_id") == F.col("v")).select("dag_id", F.col("task_id").alias("entity"), F.lit("TASK_FINISHED").alias("event"), F.col("end_time").alias("at_ms"), "num_tasks", "failed_tasks", "completed_tasks", F.col("text").alias("diagnostics"))
    attempts = failed.join(tasks.select("task_id"), "task_id", "left_semi").join(stats, F.col("vertex_id") == F.col("v"))
    of_attempts = attempts.select("dag_id", F.col("task_attempt_id").alias("entity"), F.lit("TASK_ATTEMPT_FINISHED").alias("event"), F.col("end_time").alias("at_ms"), "num_tasks", "failed_tasks", "completed_tasks", text.alias("diagnostics"))
    return of_vertices.unionByName(of_tasks).unionByName(of_attempts)


def attempts_of(facts: DataFrame, field: str) -> DataFrame:
    """(dag_id, ``field``, task_attempt_id, ``place`` from 1): which attempts of a dag each node or container ran, by start."""
    rows = facts.where(F.col(field).isNotNull()).select("dag_id", field, F.coalesce("start_time", F.lit(0)).alias("start"), "task_attempt_id")
    ranked = running_sum(rows, ["dag_id", field], ["start", "task_attempt_id"], F.lit(1), "place")
    return ranked.select("dag_id", field, "task_attempt_id", F.col("place").cast("int").alias("place"))


def post_data_metrics(facts: DataFrame, vertices: DataFrame, dags: DataFrame, edges: DataFrame) -> DataFrame:
    """Per vertex: ``data_ms`` and ``data_ta``, the last data event and its attempt; ``post_data_ms``, the mean time from the later of
    it and the start to the end over the succeeded attempt of each task, -1 for none; ``finish_interval``, from
    the dag's start to the vertex's finish, to its last attempt's end where it has none."""
    data = last_data(facts, edges)
    won = facts.where("status = 'SUCCEEDED' and task_id is not null").groupBy("vertex_id", "task_id").agg(F.max_by(F.struct("start_time", "end_time"), F.struct("end_time", "task_attempt_id")).alias("a"))
    rows = won.select("vertex_id", "a.*").join(data.select("vertex_id", "data_ms"), "vertex_id", "left")
    rows = rows.withColumn("post", post_data_ms(F.col("start_time"), F.col("end_time"), F.col("data_ms"))).where("post >= 0")
    mean = rows.groupBy("vertex_id").agg(F.floor(F.avg("post") + 0.5).cast("long").alias("post_data_ms"))
    last = facts.where("end_time > 0").groupBy("vertex_id").agg(F.max("end_time").alias("last_end"))
    out = vertices.select("vertex_id", "dag_id", "vertex_name", "finish_time").join(dags.select("dag_id", F.col("start_time").alias("dag_start")), "dag_id", "left")
    out = out.join(data, "vertex_id", "left").join(mean, "vertex_id", "left").join(last, "vertex_id", "left")
    interval = F.when(F.col("finish_time") >= F.col("dag_start"), F.col("finish_time") - F.col("dag_start")).otherwise(F.col("last_end") - F.col("dag_start"))
    return out.select("dag_id", "vertex_id", "vertex_name", "data_ta", "data_ms", F.coalesce("post_data_ms", F.lit(-1)).alias("post_data_ms"), interval.alias("finish_interval"))


def hung_tasks(facts: DataFrame) -> DataFrame:
    """Per task its number of attempts and the last one's id, status and time, longest first."""
    number = F.regexp_extract("task_attempt_id", r"_(\d+)$", 1).cast("long")
    per = facts.where("task_id is not null").groupBy("task_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.max_by(F.struct("task_attempt_id", "status", "time_taken"), F.struct(number, "task_attempt_id")).alias("last"))
    return per.select("task_id", "n_attempts", "last.*").orderBy(F.col("time_taken").desc_nulls_last(), "task_id")


def counter_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per counter the totals of two runs, absent ones as 0, and their difference."""
    a = first.groupBy("counter_group", "counter_name").agg(F.sum("value").alias("first_total"))
    b = second.groupBy("counter_group", "counter_name").agg(F.sum("value").alias("second_total"))
    both = a.join(b, ["counter_group", "counter_name"], "full_outer")
    return both.select("counter_group", "counter_name", or_zero(F.col("first_total")).alias("first_total"), or_zero(F.col("second_total")).alias("second_total"), (or_zero(F.col("second_total")) - or_zero(F.col("first_total"))).alias("delta"))


def swimlanes(facts: DataFrame) -> DataFrame:
    """Lanes of a drawing: per container its attempts in order of start, with the idle time before."""
    rows = facts.where("container_id is not null and start_time > 0 and end_time >= start_time").select("container_id", "task_attempt_id", "start_time", "end_time")
    keys, order = ["container_id"], ["start_time", "task_attempt_id"]
    rows = materialize(rows, "lanes")  # read for the largest container too
    rows = previous(running_sum(rows, keys, order, F.lit(1), "place"), keys, order, "end_time", "before")
    return rows.select("container_id", "task_attempt_id", "start_time", "end_time", F.col("place").cast("int").alias("place"), (F.col("start_time") - F.col("before")).alias("idle_ms"))


def vertex_metrics(facts: DataFrame) -> DataFrame:
    """Per vertex: attempts, least, most and mean time, mean time from creation to allocation and to start."""
    taken = F.when(F.col("time_taken") >= 0, F.col("time_taken"))
    waited = lambda a, b: rounded(F.avg(F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(b) - F.col(a))), 2)
    return facts.groupBy("dag_id", "vertex_name").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.min(taken).alias("least_ms"), F.max(taken).alias("most_ms"), rounded(F.avg(taken), 2).alias("mean_ms"),
        waited("creation_time", "allocation_time").alias("to_allocation_ms"), waited("allocation_time", "start_time").alias("to_start_ms"),
    )


def dag_extremes(vertices: DataFrame) -> DataFrame:
    """Per dag its slowest and fastest vertex, and vertices by state."""
    taken = F.when((F.col("start_time") > 0) & (F.col("finish_time") >= F.col("start_time")), F.col("finish_time") - F.col("start_time"))
    rows = vertices.where("dag_id is not null").withColumn("taken", taken)
    key = lambda sign: F.when(F.col("taken").isNotNull(), F.struct(sign * F.col("taken"), F.col("vertex_id")))
    return rows.groupBy("dag_id").agg(
        F.max_by("vertex_name", key(1)).alias("slowest"), F.max("taken").alias("slowest_ms"), F.min_by("vertex_name", key(1)).alias("fastest"), F.min("taken").alias("fastest_ms"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("n_succeeded"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), F.count_if(F.col("status") == "KILLED").alias("n_killed"),
    )


def vertex_critical_path(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per dag the path through its vertices of the greatest summed time: (dag_id, path, score).

    A dag's vertices and edges, which are its plan and so no more than its author wrote, meet in one
    shuffle; the best path to each vertex follows from those of its sources. Ties go to the path that is
    greater as text; vertices on a cycle, which no plan has, are an error.
    """
    taken = F.when((F.col("start_time") > 0) & (F.col("finish_time") >= F.col("start_time")), F.col("finish_time") - F.col("start_time")).otherwise(0)
    nodes = vertices.where("dag_id is not null").select("dag_id", "vertex_id", taken.cast("long").alias("taken"), F.lit(None).cast("string").alias("to"))
    links = edges.select("dag_id", F.col("source_vertex").alias("vertex_id"), F.lit(None).cast("long").alias("taken"), F.col("destination_vertex").alias("to"))

    def best(rows: list[tuple]) -> list[tuple]:
        time = {v: t for v, t, to in rows if to is None}
        ahead: dict[str, set[str]] = {}
        for v, _, to in rows:
            if to is not None and v in time and to in time:
                ahead.setdefault(v, set()).add(to)
        waiting = Counter(to for follow in ahead.values() for to in follow)
        ready = [v for v in time if not waiting[v]]
        # Paths are compared with a closing mark, so that one stays ahead whatever follows.
        paths = {v: (time[v], f"{v}>") for v in ready}
        done = 0
        while ready:
            v = ready.pop()
            done += 1
            for to in ahead.get(v, ()):
                paths[to] = max(paths.get(to, (-1, "")), (paths[v][0] + time[to], f"{paths[v][1]}{to}>"))
                waiting[to] -= 1
                if not waiting[to]:
                    ready.append(to)
        if done < len(time):
            raise RuntimeError("a dag's edges have a cycle")
        score, path = max((paths[v][0], paths[v][1][:-1]) for v in time if v not in ahead)
        return [(path, score)]

    return _per_dag(nodes.unionByName(links), ["vertex_id", "taken", "to"], lambda dag, rows: best(rows) if any(r[2] is None for r in rows) else [], "path string, score long")


def _per_dag(rows: DataFrame, columns: list[str], function: Callable[[str, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``function`` of each dag's rows, as (dag_id, schema...). Dags stream by in sorted partitions; rows of a dag must be few."""
    ship(rows.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, held, out = None, [], []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != dag and held:
                    out += [(dag, *r) for r in function(dag, held)]
                    held = []
                dag = key
                held.append(tuple(row))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if held:
            out += [(dag, *r) for r in function(dag, held)]
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.string(), *kinds])], names=["dag_id", *names])

    met = rows.where("dag_id is not null").select("dag_id", *columns).repartition("dag_id").sortWithinPartitions("dag_id")
    return met.mapInArrow(run, f"dag_id string, {schema}")


def _reachable(facts: DataFrame, front: DataFrame) -> DataFrame:
    """(dag_id, at, and the attempt's columns) of a few attempts (dag_id, at) and the attempts that caused them, and so on.

    Only these come near a critical path: last attempts of dags, of vertices, and the attempts that they retry.
    """
    rest = [c for c in facts.columns if c not in ("dag_id", "task_attempt_id")]
    causes = front.where("at is not null and dag_id is not null").distinct()
    causes = materialize(causes, "critical-front")
    rounds: list[DataFrame] = []
    while True:
        # The small side is read from a table of known size, so Spark broadcasts it while it is small.
        found = materialize(facts.join(causes, facts["task_attempt_id"] == causes["at"]).select(causes["dag_id"], "at", *rest), "critical-nodes")
        rounds.append(found)
        if found.isEmpty():
            return reduce(DataFrame.unionByName, rounds).distinct()
        causes = found.where("creation_causal_ta is not null").select("dag_id", F.col("creation_causal_ta").alias("at")).distinct()
        if len(rounds) % 16 == 0:  # longer chains than retries give: they may be cycles
            seen = reduce(DataFrame.unionByName, rounds).select("dag_id", "at")
            causes = materialize(causes.join(seen, ["dag_id", "at"], "left_anti"), "critical-front")


def _walk_ends(facts: DataFrame) -> DataFrame:
    """(dag_id, at): the last attempt of each dag to end as SUCCEEDED or FAILED."""
    ended = facts.where("end_time > 0 and dag_id is not null and status in ('SUCCEEDED', 'FAILED')")
    return ended.groupBy("dag_id").agg(F.max_by(F.col("task_attempt_id"), F.struct("end_time", "task_attempt_id")).alias("at"))


def critical_path(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per dag the chain of attempts that its end waited for: (dag_id, step from 0, task_attempt_id, reason).

    It begins with the last attempt to end as SUCCEEDED or FAILED. An attempt waits for the one
    that caused it (`RETRY`), else for the last attempt to succeed of its source
    vertices (`DATA`), else for nothing (`INIT`). A walk that comes back to an attempt ends with `LOOP`.
    See ``critical_path_by_data`` for the choice by time.
    """
    facts = materialize(facts.select("task_attempt_id", "vertex_id", "dag_id", "status", "creation_causal_ta", "end_time"), "critical-facts")
    last = materialize(_walk_ends(facts), "critical-ends")
    done = facts.where("end_time > 0 and dag_id is not null and status = 'SUCCEEDED'").groupBy("vertex_id").agg(F.max(F.struct("end_time", "task_attempt_id")).alias("end"))
    feeds = edges.select("dag_id", F.col("source_vertex").alias("vertex_id"), "destination_vertex").join(done, "vertex_id")
    feeds = materialize(feeds.groupBy("dag_id", F.col("destination_vertex").alias("vertex_id")).agg(F.max("end")["task_attempt_id"].alias("fed_by")), "critical-feeds")
    nodes = _reachable(facts, last.unionByName(feeds.select("dag_id", F.col("fed_by").alias("at"))))
    begun = last.select("dag_id", F.lit("end").alias("kind"), "at", F.lit(None).cast("string").alias("cause"), F.lit(None).cast("string").alias("fed_by"))
    rows = begun.unionByName(nodes.join(feeds.drop("dag_id"), "vertex_id", "left").select("dag_id", F.lit("node").alias("kind"), "at", F.col("creation_causal_ta").alias("cause"), "fed_by"))

    def walk(dag: str, rows: list[tuple]) -> list[tuple]:
        given = {at: (cause, fed_by) for kind, at, cause, fed_by in rows if kind == "node"}
        at, path, seen = next((r[1] for r in rows if r[0] == "end"), None), [], set()
        while at in given:
            if at in seen:
                path.append((len(path), at, "LOOP"))
                break
            seen.add(at)
            cause, fed_by = given[at]
            path.append((len(path), at, "RETRY" if cause is not None else "DATA" if fed_by is not None else "INIT"))
            at = cause if cause is not None else fed_by
        return path

    return _per_dag(rows, ["kind", "at", "cause", "fed_by"], walk, "step int, task_attempt_id string, reason string")


def critical_path_by_data(facts: DataFrame, events: DataFrame, edges: DataFrame, dags: DataFrame) -> DataFrame:
    """Per dag the critical path with its times: (dag_id, ``step`` from 0 at the dag's end, ``entity`` `DAG_COMMIT`, `ATTEMPT` or
    `VERTEX_INIT`, task_attempt_id, ``reason``, ``start_ms``, ``stop_ms``).

    ``events`` (vertex_id, source_ta, at_ms) are the data events that reach a vertex's attempts. Of the last one before a
    step's stop: if it came after the attempt was created, the attempt waited for it (`DATA`); else
    for the attempt that caused it, `OUTPUT_RECREATE` where that is of an output vertex of its own vertex, otherwise `RETRY`;
    without a cause for the event's source (`DATA`); without an event for nothing (`INIT`). The step before
    the first attempt is its vertex's initialisation, the one after the last is the `COMMIT`. A cause that
    the tables lack ends the path.
    """
    facts = materialize(facts.select("task_attempt_id", "task_id", "vertex_id", "vertex_name", "dag_id", "status", "creation_causal_ta", "creation_time", "end_time"), "critical-facts")
    last = materialize(_walk_ends(facts), "critical-ends")
    of_dag = edges.select("dag_id", "source_vertex", "destination_vertex")
    fed = events.join(of_dag.select("dag_id", F.col("destination_vertex").alias("vertex_id")).distinct(), "vertex_id")
    nodes = _reachable(facts, last.unionByName(fed.select("dag_id", F.col("source_ta").alias("at"))))
    columns = ["kind", "a", "b", "c", "x", "y"]
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")

    def part(df: DataFrame, kind: str, *cells: Column) -> DataFrame:
        return df.select("dag_id", F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(cells, columns[1:])])

    rows = part(last, "end", F.col("at"), text, text, number, number)
    rows = rows.unionByName(part(dags, "dag", text, text, text, F.col("start_time"), F.col("end_time")))
    rows = rows.unionByName(part(of_dag, "out", F.col("source_vertex"), F.col("destination_vertex"), text, number, number))
    rows = rows.unionByName(part(fed, "event", F.col("vertex_id"), F.col("source_ta"), text, F.col("at_ms"), number))
    rows = rows.unionByName(part(nodes, "node", F.col("at"), F.col("vertex_id"), F.col("creation_causal_ta"), F.col("creation_time"), F.col("end_time")))

    def walk(dag: str, rows: list[tuple]) -> list[tuple]:
        given = {a: (b, c, x or 0, y or 0) for kind, a, b, c, x, y in rows if kind == "node"}
        outputs = {(a, b) for kind, a, b, *_ in rows if kind == "out"}
        arrivals: dict[str, list[tuple[int, str]]] = {}
        for kind, a, b, _, x, _ in rows:
            if kind == "event":
                arrivals.setdefault(a, []).append((x, b))
        begin, finish = next(((x, y) for kind, _, _, _, x, y in rows if kind == "dag"), (None, None))
        at = next((r[1] for r in rows if r[0] == "end"), None)
        if at not in given:
            return []
        stop = given[at][3]
        path, seen = [(0, "DAG_COMMIT", at, "COMMIT", stop, finish if (finish or 0) > 0 else stop)], set()
        while at in given:
            vertex, cause, created, _ = given[at]
            when, source = max((e for e in arrivals.get(vertex, ()) if e[0] < stop), default=(0, None))
            if (at, stop) in seen:
                path.append((len(path), "ATTEMPT", at, "LOOP", stop, stop))
                break
            seen.add((at, stop))
            if source is not None and (when > created or cause is None):
                reason, follow, start = "DATA", source, when
            elif cause is not None:
                again = cause in given and (vertex, given[cause][0]) in outputs
                reason, follow = ("OUTPUT_RECREATE" if again else "RETRY"), cause
                start = created if again or cause not in given else given[cause][3]
            else:
                reason, follow, start = "INIT", None, created
            path.append((len(path), "ATTEMPT", at, reason, start, stop))
            if follow is None:
                path.append((len(path), "VERTEX_INIT", at, "INIT", begin, start))
            at, stop = follow, start
        return path

    return _per_dag(rows, columns, walk, "step int, entity string, task_attempt_id string, reason string, start_ms long, stop_ms long")


def data_stragglers(path: DataFrame, facts: DataFrame, metrics: DataFrame, slower: float = 1.25) -> DataFrame:
    """Attempts of ``critical_path_by_data`` with their time after the last data event, the mean of their vertex's
    (``metrics`` of ``post_data_metrics``), and ``straggler``: more than ``slower`` times it. Vertices without a mean have none."""
    rows = path.where("entity = 'ATTEMPT'").select("dag_id", "step", "task_attempt_id").join(facts.select("task_attempt_id", "vertex_id", "start_time", "end_time"), "task_attempt_id")
    rows = rows.join(metrics.select("vertex_id", "data_ms", F.col("post_data_ms").alias("mean_ms")), "vertex_id").where("mean_ms > 0")
    rows = rows.withColumn("own_ms", post_data_ms(F.col("start_time"), F.col("end_time"), F.col("data_ms")))
    return rows.select("dag_id", "step", "task_attempt_id", "own_ms", "mean_ms", (F.col("own_ms") > slower * F.col("mean_ms")).alias("straggler"))


def critical_path_notes(path: DataFrame, facts: DataFrame, slower: float = 1.25) -> DataFrame:
    """Steps of a critical path with the vertex's mean time, ``straggler`` (more than ``slower`` times
    it), and the wait for allocation."""
    mean = facts.where("time_taken >= 0").groupBy("dag_id", "vertex_id").agg(F.avg("time_taken").alias("mean"))
    rows = path.join(facts.select("task_attempt_id", "vertex_id", "time_taken", "creation_time", "allocation_time"), "task_attempt_id").join(mean, ["dag_id", "vertex_id"], "left")
    wait = F.when((F.col("creation_time") > 0) & (F.col("allocation_time") > 0), F.col("allocation_time") - F.col("creation_time"))
    return rows.select("dag_id", "step", "task_attempt_id", "reason", rounded(F.col("mean"), 2).alias("vertex_mean_ms"), (F.col("time_taken") > slower * F.col("mean")).alias("straggler"), wait.alias("allocation_wait_ms"))


def allocation_notes(path: DataFrame, facts: DataFrame) -> DataFrame:
    """Why a critical attempt waited for its container between creation and allocation: (dag_id, step,
    task_attempt_id, ``wait_ms``, ``busy_ms``, ``preempted``, ``note``).

    ``busy_ms`` is how long the container ran other attempts meanwhile: 0 is a newly allocated
    container, ``wait_ms`` or more a fully used one. ``preempted`` counts attempts of other
    vertices of the dag that were killed meanwhile. Attempts that didn't wait are left out.
    """
    own = path.join(facts.select("task_attempt_id", "vertex_id", "container_id", "creation_time", "allocation_time"), "task_attempt_id")
    own = materialize(own.where("creation_time > 0 and allocation_time > creation_time"), "allocation-own")
    others = facts.where("start_time > 0 and end_time >= start_time").select(F.col("task_attempt_id").alias("other"), F.col("container_id").alias("c"), F.col("vertex_id").alias("v"), F.col("dag_id").alias("d"), "start_time", "end_time", "status")
    overlap = F.greatest(F.lit(0), F.least("end_time", "allocation_time") - F.greatest("start_time", "creation_time"))
    busy = own.join(others, (F.col("container_id") == F.col("c")) & (F.col("task_attempt_id") != F.col("other")) & (F.col("start_time") < F.col("allocation_time")) & (F.col("end_time") > F.col("creation_time")))
    busy = busy.groupBy("task_attempt_id").agg(F.sum(overlap).alias("busy"))
    killed = others.where("status = 'KILLED'").select("d", "v", "end_time")
    lost = own.join(killed, (F.col("dag_id") == F.col("d")) & (F.col("vertex_id") != F.col("v")) & (F.col("end_time") > F.col("creation_time")) & (F.col("end_time") < F.col("allocation_time")))
    lost = lost.groupBy("task_attempt_id").agg(F.count(F.lit(1)).alias("lost"))
    out = own.join(busy, "task_attempt_id", "left").join(lost, "task_attempt_id", "left")
    wait, used = F.col("allocation_time") - F.col("creation_time"), or_zero(F.col("busy"))
    note = F.when(used == 0, "newly allocated").when(used >= wait, "fully used").otherwise("partly used")
    return out.select("dag_id", "step", "task_attempt_id", wait.alias("wait_ms"), used.alias("busy_ms"), or_zero(F.col("lost")).alias("preempted"), note.alias("note"))


def waves(facts: DataFrame) -> DataFrame:
    """Per vertex: tasks, most attempts at once, and waves = tasks / that, to one decimal."""
    most = task_concurrency(facts).groupBy("vertex_id").agg(F.max("running").alias("most_running"))
    tasks = facts.where("vertex_id is not null").groupBy("vertex_id").agg(F.count_distinct("task_id").alias("n_tasks"))
    return tasks.join(most, "vertex_id").where("most_running > 0").select("vertex_id", "n_tasks", "most_running", rounded(F.col("n_tasks") / F.col("most_running"), 1).alias("waves"))

