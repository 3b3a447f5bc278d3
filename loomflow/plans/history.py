"""Queries of the job-history analyzers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomflow.history import analyzers, model
from loomflow.runtime import materialize
from loomflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201 - a decorator
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.attempt_facts(table(spark, sf_dir, "attempts"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = materialize(_facts(spark, sf_dir), "facts")  # read for the attempts and for their counters
    return facts, model.derived_counters(facts)


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.vertex_facts(table(spark, sf_dir, "vertices"))


_F = f"with f as ({model.ATTEMPT_FACTS_SQL}) "
_W = f"with w as ({model.WIDE_COUNTERS_SQL}) "
_VERTICES = "dag_id vertex_name status diagnostics processor_class init_requested_time init_time start_requested_time start_time finish_time num_tasks".split()
_V = "v as (select vertex_id, " + ", ".join(f"max({c}) as {c}" for c in _VERTICES) + " from vertices where vertex_id is not null group by 1)"
_D = "d as (select dag_id, " + ", ".join(f"max({c}) as {c}" for c in ("submit_time", "start_time", "end_time", "diagnostics")) + " from dags where dag_id is not null group by 1)"
_E = "e as (select dag_id, vertex_id as source_vertex, t as destination_vertex, case when num_tasks = tn then 'ONE_TO_ONE' else 'SCATTER_GATHER' end as movement from (select *, lead(vertex_id) over o as t, lead(num_tasks) over o as tn from v window o as (partition by dag_id order by vertex_id)) where t is not null and dag_id is not null)"
_LINE = "replace(replace({}, ',', ' '), chr(10), ' ')"


@query(model.ATTEMPT_FACTS_SQL)
def history_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"select counter_group, counter_name, cast(sum(value) as bigint) as total, min(value) as least, max(value) as most from ({model.LONG_COUNTERS_SQL}) group by 1, 2")
def counter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.operators.aggregates import counter_summary as summary

    return summary(_both(spark, sf_dir)[1])


@query(_F + "select dag_id, vertex_name, container_id, count(*) as n_attempts from f where container_id is not null group by 1, 2, 3")
def container_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.container_reuse(_facts(spark, sf_dir))


_KINDS = ", ".join(
    f"round(count(*) filter (where kind = '{k}') / count(*), 6) as {k}_share, round(avg(time_taken) filter (where kind = '{k}'), 2) as {k}_ms, round(avg(hdfs_bytes_read) filter (where kind = '{k}'), 2) as {k}_bytes"
    for k in ("data", "rack", "other")
)


@query(_W + f"""select *, data_share < 0.5 as poor from (select dag_id, vertex_name, count(*) as n_attempts, {_KINDS} from (
select *, case when data_local_tasks is not null then 'data' when rack_local_tasks is not null then 'rack' when other_local_tasks is not null then 'other' end as kind from w) group by 1, 2)""")
def locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.locality(*_both(spark, sf_dir))


@query(_W + """select *, work_share < 0.5 and reduce_input_records > 10000 as slow from (
select dag_id, vertex_name, task_attempt_id, reduce_input_records, merge_phase_time, shuffle_phase_time, round(reduce_input_groups / reduce_input_records, 6) as groups_share,
  round((time_taken - shuffle_phase_time - merge_phase_time) / nullif(time_taken, 0), 6) as work_share from w where reduce_input_records > 0)""")
def shuffle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.shuffle_time(*_both(spark, sf_dir))


@query(_W + """, s as (select *, reduce_input_groups / nullif(reduce_input_records, 0) as g, reduce_input_records / nullif(sum(reduce_input_records) over (partition by dag_id, vertex_name), 0) as p, count(*) over (partition by dag_id, vertex_name) as n from w),
x as (select *, case when shuffle_bytes > 943718400 and g < 0.2 then 'partitioning' end as finding from s
  union all select *, case when n > 1 and p > 0.6 then 'skew above 0.6' when n > 1 and p > 0.4 then 'skew above 0.4' end from s
  union all select *, case when shuffle_bytes > 943718400 and g > 0.2 and g < 0.4 then 'parallelism' end from s)
select dag_id, vertex_name, task_attempt_id, shuffle_bytes, round(g, 6) as groups_share, round(p, 6) as records_share, finding from x where finding is not null""")
def skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.skew(*_both(spark, sf_dir))


_P = ", ".join(f"round(quantile_cont(time_taken, {q}), 6) as {n}" for q, n in ((0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.98, "p98"), (0.99, "p99")))


@query(_W + f"""select *, case when p75 / nullif(p99, 0) < 0.5 then 'straggler' when shuffle_max_ms / nullif(makespan_ms, 0) > 0.5 then 'shuffle or late parent' when makespan_ms > 100000 then 'slow vertex' end as finding
from (select dag_id, vertex_name, max(end_time) - min(start_time) as makespan_ms, max(coalesce(shuffle_phase_time, 0)) as shuffle_max_ms, max(end_time) as last_end, {_P} from w where start_time > 0 and end_time >= start_time group by 1, 2)""")
def slowest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.slowest_vertex(*_both(spark, sf_dir))


@query(_W + "select dag_id, vertex_name, max(end_time) - min(start_time) as makespan_ms, " + ", ".join(f"cast(quantile_disc(time_taken, {q}) as double) as {n}" for q, n in ((0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.98, "p98"), (0.99, "p99"))) + " from w where start_time > 0 and end_time >= start_time group by 1, 2")
def slowest_vertex_summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of attempt times from mergeable summaries, as a vertex with much of the data needs them: values that occur,
    exact for vertices of up to 10,000 attempts."""
    return analyzers.slowest_vertex(*_both(spark, sf_dir), exact=False).select("dag_id", "vertex_name", "makespan_ms", "p50", "p75", "p95", "p98", "p99")


_N = ", ".join(f"count(*) filter (where status = '{s}') as n_{s.lower()}, coalesce(round(avg(time_taken) filter (where status = '{s}'), 2), 0.0) as {s.lower()}_ms" for s in ("SUCCEEDED", "FAILED", "KILLED"))


@query(_W + f"select node_id, count(*) as n_attempts, {_N}, round(avg(hdfs_bytes_read), 2) as mean_hdfs_bytes_read, round(avg(shuffle_bytes), 2) as mean_shuffle_bytes from w where node_id is not null group by 1")
def slow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.slow_nodes(*_both(spark, sf_dir))


@query(_F + "select task_attempt_id, dag_id, vertex_name, time_taken, status from f where time_taken is not null order by time_taken desc, task_attempt_id limit 100")
def slow_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.slow_tasks(_facts(spark, sf_dir), 100)


@query(_W + "select dag_id, vertex_name, task_attempt_id, additional_spill_count, output_bytes from w where additional_spill_count > 1 and output_bytes > 1073741824")
def spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.spill(*_both(spark, sf_dir))


@query(_F + ", p as (select node_id, count(*) as n_attempts from f where node_id is not null group by 1) select *, round(n_attempts * 100 / (select avg(n_attempts) from p), 2) as load_percent from p")
def task_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.task_assignment(_facts(spark, sf_dir))


@query(_F + "select vertex_name, node_id, case when termination_cause is null or termination_cause = '' then status else status || ':' || termination_cause end as outcome, count(*) as n_attempts from f group by 1, 2, 3")
def result_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.result_statistics(_facts(spark, sf_dir))


@query(_F + f"select dag_id, vertex_name, task_attempt_id, termination_cause, end_time, node_id, {_LINE.format('diagnostics')} as diagnostics from f where termination_cause in ('INPUT_READ_ERROR', 'OUTPUT_LOST', 'NODE_FAILED')")
def input_read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.input_read_errors(_facts(spark, sf_dir))


_CONCURRENCY = """c as (select dag_id, vertex_id, at_ms, kind, cast(sum(sum(d)) over (partition by dag_id, vertex_id order by at_ms, o rows between unbounded preceding and current row) as bigint) as running from (
  select dag_id, vertex_id, start_time as at_ms, 'START' as kind, 0 as o, 1 as d from f where start_time > 0 and end_time >= start_time and vertex_id is not null
  union all select dag_id, vertex_id, end_time, 'FINISH', 1, -1 from f where start_time > 0 and end_time >= start_time and vertex_id is not null) group by dag_id, vertex_id, at_ms, kind, o)"""


@query(_F + ", " + _CONCURRENCY + " select * from c")
def task_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.task_concurrency(_facts(spark, sf_dir))


@query(_F + ", " + _CONCURRENCY + """, m as (select vertex_id, max(running) as most_running from c group by 1), t as (select vertex_id, count(distinct task_id) as n_tasks from f where vertex_id is not null group by 1)
select vertex_id, n_tasks, most_running, round(n_tasks / most_running, 1) as waves from t join m using (vertex_id) where most_running > 0""")
def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.waves(_facts(spark, sf_dir))


@query(_F + f""", {_V}, {_E}, l as (select vertex_id, cast(nullif(regexp_extract(task_id, '_(\\d+)$', 1), '') as bigint) as task_no, arg_max(node_id, (end_time, task_attempt_id)) as node from f where status = 'SUCCEEDED' and node_id is not null and task_id is not null group by 1, 2)
select e.dag_id, source_vertex, destination_vertex, a.task_no, a.node as source_node, b.node as destination_node from e join l a on a.vertex_id = source_vertex join l b on b.vertex_id = destination_vertex and a.task_no = b.task_no
where movement = 'ONE_TO_ONE' and a.node <> b.node""")
def one_to_one_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.one_to_one_edges(_facts(spark, sf_dir), model.chain_edges(_vertices(spark, sf_dir)))


_LIFE = [("d", "dag_id", "DAG_SUBMITTED", "submit_time", "null"), ("d", "dag_id", "DAG_STARTED", "start_time", "null"), ("d", "dag_id", "DAG_FINISHED", "end_time", _LINE.format("diagnostics"))]
_LIFE += [("v", "vertex_id", "VERTEX_INITIALIZED", "init_time", "null"), ("v", "vertex_id", "VERTEX_STARTED", "start_time", "null"), ("v", "vertex_id", "VERTEX_FINISHED", "finish_time", _LINE.format("diagnostics"))]
_LIFE += [("f", "task_attempt_id", "ATTEMPT_FAILED", "end_time", _LINE.format("diagnostics"))]


@query(_F + f", {_V}, {_D} " + " union all ".join(
    f"select dag_id, {e} as entity, '{n}' as event, {t} as at_ms, cast({x} as varchar) as diagnostics from {r} where {t} > 0 and dag_id is not null" + (" and status = 'FAILED'" if r == "f" else "") for r, e, n, t, x in _LIFE
))
def dag_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.dag_overview(model.dag_facts(table(spark, sf_dir, "dags")), _vertices(spark, sf_dir), _facts(spark, sf_dir))


@query(_F + """select task_id, n_attempts, l.task_attempt_id as task_attempt_id, l.status as status, l.time_taken as time_taken from (
select task_id, count(*) as n_attempts, arg_max({task_attempt_id: task_attempt_id, status: status, time_taken: time_taken}, (cast(nullif(regexp_extract(task_attempt_id, '_(\\d+)$', 1), '') as bigint), task_attempt_id)) as l from f where task_id is not null group by 1)""")
def hung_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.hung_tasks(_facts(spark, sf_dir))


@query(_F + f""", k as ({model.LONG_COUNTERS_SQL}), t as (select counter_group, counter_name, sum(value) filter (where status = 'SUCCEEDED') as a, sum(value) filter (where status <> 'SUCCEEDED') as b from k join f on entity_id = task_attempt_id group by 1, 2)
select counter_group, counter_name, cast(coalesce(a, 0) as bigint) as first_total, cast(coalesce(b, 0) as bigint) as second_total, cast(coalesce(b, 0) - coalesce(a, 0) as bigint) as delta from t""")
def counter_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of succeeded attempts against those of all others."""
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.counter_difference(model.derived_counters(facts.where("status = 'SUCCEEDED'")), model.derived_counters(facts.where("status <> 'SUCCEEDED'")))


@query(_F + "select container_id, task_attempt_id, start_time, end_time, cast(row_number() over o as integer) as place, start_time - lag(end_time) over o as idle_ms from f where container_id is not null and start_time > 0 and end_time >= start_time window o as (partition by container_id order by start_time, task_attempt_id)")
def swimlanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.swimlanes(_facts(spark, sf_dir))


_WAIT = "round(avg({b} - {a}) filter (where {a} > 0 and {b} > 0), 2)"


@query(_F + "select dag_id, vertex_name, count(*) as n_attempts, min(time_taken) filter (where time_taken >= 0) as least_ms, max(time_taken) filter (where time_taken >= 0) as most_ms, round(avg(time_taken) filter (where time_taken >= 0), 2) as mean_ms, "
       + _WAIT.format(a="creation_time", b="allocation_time") + " as to_allocation_ms, " + _WAIT.format(a="allocation_time", b="start_time") + " as to_start_ms from f group by 1, 2")
def vertex_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.vertex_metrics(_facts(spark, sf_dir))


_TAKEN = "case when start_time > 0 and finish_time >= start_time then finish_time - start_time end"


@query(f"with {_V} select dag_id, arg_max(vertex_name, (t, vertex_id)) filter (where t is not null) as slowest, max(t) as slowest_ms, arg_min(vertex_name, (t, vertex_id)) filter (where t is not null) as fastest, min(t) as fastest_ms, count(*) filter (where status = 'SUCCEEDED') as n_succeeded, count(*) filter (where status = 'FAILED') as n_failed, count(*) filter (where status = 'KILLED') as n_killed from (select *, {_TAKEN} as t from v) where dag_id is not null group by 1")
def dag_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.dag_extremes(_vertices(spark, sf_dir))


@query(f"""with recursive {_V}, e as (select dag_id, vertex_id as s, lead(vertex_id) over o as t from v where dag_id is not null window o as (partition by dag_id order by vertex_id)
  union all select dag_id, vertex_id, lead(vertex_id, 3) over o from v where dag_id is not null window o as (partition by dag_id order by vertex_id)),
n as (select dag_id, vertex_id, coalesce({_TAKEN}, 0) as t from v where dag_id is not null),
p as (select dag_id, vertex_id, t as score, vertex_id as path from n where not exists (select 1 from e where e.t = n.vertex_id)
  union all select n.dag_id, n.vertex_id, p.score + n.t, p.path || '>' || n.vertex_id from p join e on e.s = p.vertex_id join n on n.vertex_id = e.t)
select dag_id, cast(b.score as bigint) as score, b.path as path from (select dag_id, max({{score: score, path: path}}) as b from p where not exists (select 1 from e where e.s = p.vertex_id and e.t is not null) group by 1)""")
def vertex_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over edges to the next vertex and to the third one after it."""
    v = _vertices(spark, sf_dir)
    return analyzers.vertex_critical_path(v, model.chain_edges(v).unionByName(model.chain_edges(v, 3)))


_CRITICAL = f"""with recursive f as ({model.ATTEMPT_FACTS_SQL}), {_V}, {_E},
done as (select vertex_id, max({{a: end_time, b: task_attempt_id}}) as m from f where end_time > 0 and dag_id is not null and status = 'SUCCEEDED' group by 1),
feeds as (select destination_vertex as vertex_id, max(m).b as fed_by from e join done on done.vertex_id = source_vertex group by 1),
n as (select f.task_attempt_id as id, creation_causal_ta as cause, fed_by from f left join feeds using (vertex_id)),
p as (select dag_id, 0 as step, arg_max(task_attempt_id, (end_time, task_attempt_id)) as id from f where end_time > 0 and dag_id is not null and status in ('SUCCEEDED', 'FAILED') group by 1
  union all select p.dag_id, step + 1, coalesce(cause, fed_by) from p join n using (id) where coalesce(cause, fed_by) in (select task_attempt_id from f))
select dag_id, step, id as task_attempt_id, case when cause is not null then 'RETRY' when fed_by is not null then 'DATA' else 'INIT' end as reason from p join n using (id)"""


@query(_CRITICAL)
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.critical_path(_facts(spark, sf_dir), model.chain_edges(_vertices(spark, sf_dir)))


@query(_CRITICAL.replace("select dag_id, step, id as", ", path as (select dag_id, step, id as", 1) + """),
m as (select dag_id, vertex_id, avg(time_taken) as mean from f where time_taken >= 0 group by 1, 2)
select path.dag_id, step, path.task_attempt_id, reason, round(mean, 2) as vertex_mean_ms, time_taken > 1.25 * mean as straggler, case when creation_time > 0 and allocation_time > 0 then allocation_time - creation_time end as allocation_wait_ms
from path join f on f.task_attempt_id = path.task_attempt_id left join m on m.dag_id = path.dag_id and m.vertex_id = f.vertex_id""")
def critical_path_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.critical_path_notes(analyzers.critical_path(facts, model.chain_edges(_vertices(spark, sf_dir))), facts)


@query(_CRITICAL.replace("select dag_id, step, id as", ", path as (select dag_id, step, id as", 1) + """),
o as (select path.dag_id, step, path.task_attempt_id as a, vertex_id, container_id, creation_time as x, allocation_time as y from path join f using (task_attempt_id) where creation_time > 0 and allocation_time > creation_time),
g as (select * from f where start_time > 0 and end_time >= start_time),
b as (select a, sum(least(end_time, y) - greatest(start_time, x)) as busy from o join g on g.container_id = o.container_id and task_attempt_id <> a and start_time < y and end_time > x group by 1),
k as (select a, count(*) as lost from o join g on g.dag_id = o.dag_id and g.vertex_id <> o.vertex_id and end_time > x and end_time < y and status = 'KILLED' group by 1)
select dag_id, step, a as task_attempt_id, y - x as wait_ms, cast(coalesce(busy, 0) as bigint) as busy_ms, coalesce(lost, 0) as preempted,
  case when coalesce(busy, 0) = 0 then 'newly allocated' when busy >= y - x then 'fully used' else 'partly used' end as note from o left join b using (a) left join k using (a)""")
def allocation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.allocation_notes(analyzers.critical_path(facts, model.chain_edges(_vertices(spark, sf_dir))), facts)


_S = _F + f", s as ({model.SOURCE_COUNTERS_SQL}) "
_SOURCE_COLUMNS = "dag_id, vertex_name, task_attempt_id, node_id, time_taken, counter_group, " + ", ".join(n.lower() for n in model.SOURCE_COUNTERS)


@query(_S + f"""select {_SOURCE_COLUMNS}, round(reduce_input_groups / reduce_input_records, 6) as groups_share, time_taken - merge_phase_time as work_ms,
last_event_received - first_event_received as events_ms, (time_taken - merge_phase_time) / nullif(time_taken, 0) < 0.5 as slow from s where reduce_input_records > 10000 and reduce_input_groups > 0""")
def shuffle_time_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.shuffle_time_by_source(facts, model.source_counters(facts))


@query(_S + """, t as (select *, reduce_input_groups / nullif(reduce_input_records, 0) as g, reduce_input_records / nullif(sum(reduce_input_records) over w, 0) as p, count(*) over w as n from s window w as (partition by dag_id, vertex_name, counter_group)),
x as (select *, case when shuffle_bytes > 943718400 and g < 0.2 then 'partitioning' end as finding from t
  union all select *, case when n > 1 and p > 0.6 then 'skew above 0.6' when n > 1 and p > 0.4 then 'skew above 0.4' end from t
  union all select *, case when shuffle_bytes > 943718400 and g > 0.2 and g < 0.4 then 'parallelism' end from t)
select dag_id, vertex_name, counter_group, task_attempt_id, shuffle_bytes, round(g, 6) as groups_share, round(p, 6) as records_share, finding from x where finding is not null""")
def skew_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.skew_by_source(facts, model.source_counters(facts))


@query(_F + f", w as ({model.NODE_COUNTERS_SQL}) select split_part(node_id, ':', 1) as host, count(*) as n_attempts, {_N}, " + ", ".join(f"coalesce(round(avg({n.lower()}), 2), 0.0) as mean_{n.lower()}" for n in model.NODE_COUNTERS) + " from w where node_id is not null group by 1")
def slow_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.slow_hosts(facts, model.node_counters(facts))


@query(_F + f""", v as (select vertex_id, max(finish_time) as finish_time, max(num_tasks) as num_tasks, max(failed_tasks) as failed_tasks, max(completed_tasks) as completed_tasks from vertices where vertex_id is not null group by 1),
x as (select *, {_LINE.format("coalesce(diagnostics, '')")} as text from f),
k as (select task_id, arg_max({{d: dag_id, v: vertex_id, s: status, e: end_time, t: text}}, (cast(nullif(regexp_extract(task_attempt_id, '_(\\d+)$', 1), '') as bigint), task_attempt_id)) as l from x where task_id is not null group by 1),
b as (select * from k where l.s = 'FAILED' and l.d is not null),
r as (select dag_id, vertex_id as v, vertex_id as entity, 'VERTEX_FINISHED' as event, cast(null as bigint) as e, arg_min(task_attempt_id || ': ' || text, task_attempt_id) as diagnostics from x where status = 'FAILED' and vertex_id is not null and dag_id is not null group by 1, 2
  union all select l.d, l.v, task_id, 'TASK_FINISHED', l.e, l.t from b
  union all select dag_id, vertex_id, task_attempt_id, 'TASK_ATTEMPT_FINISHED', end_time, text from x where status = 'FAILED' and dag_id is not null and task_id in (select task_id from b))
select dag_id, entity, event, case when event = 'VERTEX_FINISHED' then finish_time else e end as at_ms, num_tasks, failed_tasks, completed_tasks, diagnostics from r join v on v.vertex_id = r.v""")
def dag_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    return analyzers.dag_failures(_vertices(spark, sf_dir), facts)


_PLACES = "select dag_id, {f}, task_attempt_id, cast(row_number() over (partition by dag_id, {f} order by coalesce(start_time, 0), task_attempt_id) as integer) as place from f where {f} is not null"


@query(_F + _PLACES.format(f="node_id"))
def attempts_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.attempts_of(materialize(_facts(spark, sf_dir), "facts"), "node_id")


@query(_F + _PLACES.format(f="container_id"))
def attempts_of_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.attempts_of(materialize(_facts(spark, sf_dir), "facts"), "container_id")


_DATA = "done as (select vertex_id, max({a: end_time, b: task_attempt_id}) as m from f where end_time > 0 and status = 'SUCCEEDED' group by 1), data as (select destination_vertex as vertex_id, max(m).b as data_ta, max(m).a as data_ms from e join done on done.vertex_id = source_vertex group by 1)"


@query(_F + f""", {_V}, {_D}, {_E}, {_DATA},
won as (select vertex_id, task_id, arg_max({{s: start_time, e: end_time}}, (end_time, task_attempt_id)) as a from f where status = 'SUCCEEDED' and task_id is not null group by 1, 2),
post as (select vertex_id, case when a.s > 0 and a.e > 0 then a.e - greatest(a.s, coalesce(data_ms, a.s)) else -1 end as p from won left join data using (vertex_id)),
mean as (select vertex_id, cast(floor(avg(p) + 0.5) as bigint) as post_data_ms from post where p >= 0 group by 1),
last as (select vertex_id, max(end_time) as last_end from f where end_time > 0 group by 1)
select v.dag_id, v.vertex_id, v.vertex_name, data_ta, data_ms, coalesce(post_data_ms, -1) as post_data_ms, case when v.finish_time >= d.start_time then v.finish_time - d.start_time else last_end - d.start_time end as finish_interval
from v left join d on d.dag_id = v.dag_id left join data on data.vertex_id = v.vertex_id left join mean on mean.vertex_id = v.vertex_id left join last on last.vertex_id = v.vertex_id""")
def post_data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, vertices = materialize(_facts(spark, sf_dir), "facts"), _vertices(spark, sf_dir)
    return analyzers.post_data_metrics(facts, vertices, model.dag_facts(table(spark, sf_dir, "dags")), model.chain_edges(vertices))


_BY_DATA = f"""with recursive f as ({model.ATTEMPT_FACTS_SQL}), {_V}, {_D},
o as (select dag_id, vertex_id as s, lead(vertex_id) over w as t from v where dag_id is not null window w as (partition by dag_id order by vertex_id)
  union all select dag_id, vertex_id, lead(vertex_id, 3) over w from v where dag_id is not null window w as (partition by dag_id order by vertex_id)),
done as (select vertex_id, max({{a: end_time, b: task_attempt_id}}) as m from f where end_time > 0 and status = 'SUCCEEDED' group by 1),
ev as (select vertex_id, source_ta, at_ms, lead(at_ms) over (partition by vertex_id order by at_ms, source_ta) as until from (select distinct o.t as vertex_id, m.b as source_ta, m.a as at_ms from o join done on done.vertex_id = o.s where o.t is not null)),
e0 as (select dag_id, arg_max(task_attempt_id, (end_time, task_attempt_id)) as id, max(end_time) as stop from f where end_time > 0 and dag_id is not null and status in ('SUCCEEDED', 'FAILED') group by 1),
n as (select f.task_attempt_id as id, f.vertex_id, f.creation_causal_ta as cause, coalesce(f.creation_time, 0) as created, c.task_attempt_id as cause_id, coalesce(c.end_time, 0) as cause_end, exists (select 1 from o where o.s = f.vertex_id and o.t = c.vertex_id) as again
  from f left join f c on c.task_attempt_id = f.creation_causal_ta),
k as (select n.*, source_ta, at_ms, until from n left join ev on ev.vertex_id = n.vertex_id union all select n.*, null, null, (select min(at_ms) from ev where ev.vertex_id = n.vertex_id) from n where exists (select 1 from ev where ev.vertex_id = n.vertex_id)),
p as (select dag_id, 1 as step, id, stop from e0
  union all select p.dag_id, step + 1, case when source_ta is not null and (at_ms > created or cause is null) then source_ta else cause end,
    case when source_ta is not null and (at_ms > created or cause is null) then at_ms when again or cause_id is null then created else cause_end end
  from p join k on k.id = p.id and (at_ms is null or at_ms < stop) and (until is null or until >= stop)
  where case when source_ta is not null and (at_ms > created or cause is null) then source_ta else cause end is not null),
q as (select p.*, k.vertex_id, source_ta, at_ms, cause, created, again, cause_id, cause_end, source_ta is not null and (at_ms > created or cause is null) as by_data from p join k on k.id = p.id and (at_ms is null or at_ms < stop) and (until is null or until >= stop)),
r as (select dag_id, step, 'ATTEMPT' as entity, id as task_attempt_id, case when by_data then 'DATA' when cause is not null then case when again then 'OUTPUT_RECREATE' else 'RETRY' end else 'INIT' end as reason,
    case when by_data then at_ms when cause is not null and not again and cause_id is not null then cause_end else created end as start_ms, stop as stop_ms from q),
x as (select * from r
  union all select e0.dag_id, 0, 'DAG_COMMIT', id, 'COMMIT', stop, case when d.end_time > 0 then d.end_time else stop end from e0 left join d using (dag_id)
  union all select r.dag_id, step + 1, 'VERTEX_INIT', task_attempt_id, 'INIT', d.start_time, start_ms from r left join d using (dag_id) where reason = 'INIT')"""


def _by_data(spark: SparkSession, sf_dir: str, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    vertices = _vertices(spark, sf_dir)
    edges = materialize(model.chain_edges(vertices).unionByName(model.chain_edges(vertices, 3)), "edges")
    dags = model.dag_facts(table(spark, sf_dir, "dags"))
    return analyzers.critical_path_by_data(facts, model.data_events(facts, edges), edges, dags), vertices, edges, dags


@query(_BY_DATA + " select * from x")
def critical_path_by_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over edges to the next vertex and to the third one after it."""
    return _by_data(spark, sf_dir, materialize(_facts(spark, sf_dir), "facts"))[0]


@query(_BY_DATA + f""", data as (select vertex_id, max(at_ms) as data_ms from ev group by 1),
won as (select vertex_id, task_id, arg_max({{s: start_time, e: end_time}}, (end_time, task_attempt_id)) as a from f where status = 'SUCCEEDED' and task_id is not null group by 1, 2),
post as (select vertex_id, case when a.s > 0 and a.e > 0 then a.e - greatest(a.s, coalesce(data_ms, a.s)) else -1 end as p from won left join data using (vertex_id)),
mean as (select vertex_id, cast(floor(avg(p) + 0.5) as bigint) as mean_ms from post where p >= 0 group by 1),
y as (select r.dag_id, step, r.task_attempt_id, mean_ms, case when f.start_time > 0 and f.end_time > 0 then f.end_time - greatest(f.start_time, coalesce(data_ms, f.start_time)) else -1 end as own_ms
  from r join f using (task_attempt_id) join v on v.vertex_id = f.vertex_id join mean on mean.vertex_id = f.vertex_id left join data on data.vertex_id = f.vertex_id where mean_ms > 0)
select dag_id, step, task_attempt_id, own_ms, mean_ms, own_ms > 1.25 * mean_ms as straggler from y""")
def data_stragglers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(_facts(spark, sf_dir), "facts")
    path, vertices, edges, dags = _by_data(spark, sf_dir, facts)
    return analyzers.data_stragglers(path, facts, analyzers.post_data_metrics(facts, vertices, dags, edges))


def _rounding(sql: str) -> str:
    """Writes ``round(x, d)`` as ``scalars.rounded`` has it."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        scale = 10 ** int(sql[comma + 1 : i - 1])
        out += sql[at:start] + f"(floor(({sql[start + 6 : comma]}) * {scale}.0::double + 0.5) / {scale})"
        at = i
    return out + sql[at:]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _rounding(sql) for name, sql in SQL.items()}
