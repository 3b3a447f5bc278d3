"""Analyzers on a hand-made history with the cases that the tables may not hold."""

import pytest
from pyspark.sql import functions as F

from loomflow.history import analyzers, model

ATTEMPT = "task_attempt_id string, task_id string, vertex_id string, dag_id string, vertex_name string, container_id string, node_id string, status string, termination_cause string, creation_causal_ta string, diagnostics string, creation_time long, allocation_time long, start_time long, end_time long, time_taken long, execution_time_interval long"


def attempt(name, vertex, container, node, status, start, end, cause=None, causal=None, text=None):
    return (name, name.rsplit("_", 1)[0], vertex, "d", vertex.upper(), container, node, status, cause, causal, text, start - 5, start - 2, start, end, end - start, end - start)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        attempt("v0_00_0", "v0", "c1", "n1", "SUCCEEDED", 100, 200),
        attempt("v0_01_0", "v0", "c2", "n2", "SUCCEEDED", 100, 250),
        attempt("v1_00_0", "v1", "c1", "n1", "FAILED", 250, 300, "OUTPUT_LOST", None, "a,b\nc"),
        attempt("v1_00_1", "v1", "c2", "n2", "SUCCEEDED", 300, 500, None, "v1_00_0"),
        attempt("v1_01_0", "v1", "c3", "n2", "SUCCEEDED", 260, 300),
        attempt("v1_02_0", "v1", "c3", "n2", "KILLED", 300, 310),
    ]
    return model.attempt_facts(spark.createDataFrame(rows, ATTEMPT))


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("d", "v0", "v1", "ONE_TO_ONE")], "dag_id string, source_vertex string, destination_vertex string, movement string")


def counters(spark, rows):
    return spark.createDataFrame([(e, "G", n, v) for e, n, v in rows], "entity_id string, counter_group string, counter_name string, value long")


def test_facts_prefer_filled_and_final(spark):
    a = list(attempt("x_00_0", "v0", None, "n", "RUNNING", 5, 9))
    b = list(attempt("x_00_0", "v0", "c", None, "SUCCEEDED", 5, 9))
    row = model.attempt_facts(spark.createDataFrame([tuple(a), tuple(b), tuple([None, *b[1:]])], ATTEMPT)).collect()
    assert [(r.container_id, r.node_id, r.status) for r in row] == [("c", "n", "SUCCEEDED")]


def test_critical_path(facts, edges):
    got = sorted((r.step, r.task_attempt_id, r.reason) for r in analyzers.critical_path(facts, edges).collect())
    assert got == [(0, "v1_00_1", "RETRY"), (1, "v1_00_0", "DATA"), (2, "v0_01_0", "INIT")]
    notes = analyzers.critical_path_notes(analyzers.critical_path(facts, edges), facts).orderBy("step").collect()
    assert notes[0].straggler and notes[0].allocation_wait_ms == 3 and not notes[2].straggler


def test_allocation_notes(spark):
    def row(name, vertex, container, status, created, allocated, start, end):
        return (name, name[:-2], vertex, "d", vertex, container, "n", status, None, None, None, created, allocated, start, end, end - start, end - start)

    rows = [row("a_00_0", "a", "c1", "SUCCEEDED", 1, 2, 10, 60), row("b_00_0", "b", "c1", "SUCCEEDED", 20, 100, 110, 200), row("z_00_0", "z", "c9", "KILLED", 5, 5, 30, 70)]
    f = model.attempt_facts(spark.createDataFrame(rows, ATTEMPT))
    path = spark.createDataFrame([("d", 0, "b_00_0", "DATA"), ("d", 1, "a_00_0", "INIT")], "dag_id string, step int, task_attempt_id string, reason string")
    got = {r.task_attempt_id: (r.wait_ms, r.busy_ms, r.preempted, r.note) for r in analyzers.allocation_notes(path, f).collect()}
    assert got == {"b_00_0": (80, 40, 1, "partly used"), "a_00_0": (1, 0, 0, "newly allocated")}


def test_concurrency_counts_starts_before_finishes(facts):
    got = [(r.at_ms, r.kind, r.running) for r in analyzers.task_concurrency(facts).where("vertex_id = 'v1'").orderBy("at_ms", F.col("kind").desc()).collect()]
    assert got == [(250, "START", 1), (260, "START", 2), (300, "START", 4), (300, "FINISH", 2), (310, "FINISH", 1), (500, "FINISH", 0)]


def test_slow_tasks_gives_exactly_k(facts):
    assert [r.task_attempt_id for r in analyzers.slow_tasks(facts, 2).collect()] == ["v1_00_1", "v0_01_0"]


def test_hung_tasks_last_attempt(facts):
    row = analyzers.hung_tasks(facts).first()
    assert (row.task_id, row.n_attempts, row.task_attempt_id, row.status) == ("v1_00", 2, "v1_00_1", "SUCCEEDED")


def test_one_to_one_edge_across_nodes(facts, edges):
    got = [(r.task_no, r.source_node, r.destination_node) for r in analyzers.one_to_one_edges(facts, edges).collect()]
    assert got == [(0, "n1", "n2")]


def test_input_read_errors_one_line(facts):
    assert [(r.task_attempt_id, r.diagnostics) for r in analyzers.input_read_errors(facts).collect()] == [("v1_00_0", "a b c")]


def test_assignment_reuse_and_outcomes(facts):
    assert {r.node_id: r.load_percent for r in analyzers.task_assignment(facts).collect()} == {"n1": 66.67, "n2": 133.33}
    assert {(r.container_id, r.n_attempts) for r in analyzers.container_reuse(facts).where("vertex_name = 'V1'").collect()} == {("c1", 1), ("c2", 1), ("c3", 2)}
    assert ("OUTPUT_LOST" in str(analyzers.result_statistics(facts).collect())) is True


def test_spill_threshold(spark, facts):
    c = counters(spark, [("v0_00_0", "ADDITIONAL_SPILL_COUNT", 2), ("v0_00_0", "OUTPUT_BYTES", 2**30), ("v0_01_0", "ADDITIONAL_SPILL_COUNT", 2), ("v0_01_0", "OUTPUT_BYTES", 2**30 + 1), ("v1_00_0", "ADDITIONAL_SPILL_COUNT", 1), ("v1_00_0", "OUTPUT_BYTES", 2**40)])
    assert [r.task_attempt_id for r in analyzers.spill(facts, c).collect()] == ["v0_01_0"]


def test_skew_thresholds(spark, facts):
    big = 900 * 2**20 + 1
    rows = [("v1_00_0", "REDUCE_INPUT_RECORDS", 61), ("v1_00_1", "REDUCE_INPUT_RECORDS", 39), ("v0_00_0", "REDUCE_INPUT_RECORDS", 41), ("v0_01_0", "REDUCE_INPUT_RECORDS", 59)]
    rows += [(a, "SHUFFLE_BYTES", big) for a in ("v0_00_0", "v0_01_0")] + [("v0_00_0", "REDUCE_INPUT_GROUPS", 8), ("v0_01_0", "REDUCE_INPUT_GROUPS", 20)]
    got = {(r.task_attempt_id, r.finding) for r in analyzers.skew(facts, counters(spark, rows)).collect()}
    assert got == {("v1_00_0", "skew above 0.6"), ("v0_00_0", "skew above 0.4"), ("v0_01_0", "skew above 0.4"), ("v0_00_0", "partitioning"), ("v0_01_0", "parallelism")}


def test_slowest_vertex_exact_and_summarised(spark, facts):
    c = counters(spark, [("v1_00_1", "SHUFFLE_PHASE_TIME", 200), ("v0_00_0", "SHUFFLE_PHASE_TIME", 1)])
    got = {r.vertex_name: r for r in analyzers.slowest_vertex(facts, c, slow_ms=100).collect()}
    assert (got["V1"].makespan_ms, got["V1"].shuffle_max_ms, got["V1"].last_end, got["V1"].p50) == (250, 200, 500, 45)
    assert got["V1"].finding == "straggler" and got["V0"].finding == "slow vertex"
    near = {r.vertex_name: r for r in analyzers.slowest_vertex(facts, c, exact=False).collect()}
    assert near["V1"].p99 == 200 and near["V0"].p50 == 100


def test_counter_difference_missing_is_zero(spark):
    got = {r.counter_name: (r.first_total, r.second_total, r.delta) for r in analyzers.counter_difference(counters(spark, [("a", "X", 5), ("a", "Y", 1)]), counters(spark, [("b", "X", 2), ("b", "Z", 4)])).collect()}
    assert got == {"X": (5, 2, -3), "Y": (1, 0, -1), "Z": (0, 4, 4)}


def test_vertex_critical_path(spark):
    nodes = [("a", 10), ("b", 50), ("c", 20), ("e", 5), ("lone", 7)]
    v = spark.createDataFrame([("d", n, 1, 1 + t) for n, t in nodes], "dag_id string, vertex_id string, start_time long, finish_time long")
    e = spark.createDataFrame([("d", "a", "b"), ("d", "a", "c"), ("d", "b", "e"), ("d", "c", "e")], "dag_id string, source_vertex string, destination_vertex string")
    assert [tuple(r) for r in analyzers.vertex_critical_path(v, e).collect()] == [("d", "a>b>e", 65)]


def test_empty_history(spark, facts, edges):
    none, no_edges = facts.limit(0), edges.limit(0)
    c = counters(spark, [])
    for rows in (analyzers.locality(none, c), analyzers.shuffle_time(none, c), analyzers.skew(none, c), analyzers.slowest_vertex(none, c), analyzers.slow_nodes(none, c), analyzers.task_concurrency(none), analyzers.hung_tasks(none), analyzers.critical_path(none, no_edges), analyzers.waves(none), analyzers.swimlanes(none)):
        assert rows.count() == 0


def history(spark):
    """A dag of three vertices; b1 is created again because of a lost output that c0 reported, c0 failed once."""
    facts = [
        # task_attempt_id, task_id, vertex_id, vertex_name, status, cause, creation, start, end
        ("a0", "ta", "A", "a", "SUCCEEDED", None, 10, 12, 100), ("b0", "tb", "B", "b", "SUCCEEDED", None, 20, 25, 200), ("b1", "tb", "B", "b", "SUCCEEDED", "c0", 300, 310, 400),
        ("c0", "tc", "C", "c", "FAILED", None, 250, 255, 290), ("c1", "tc", "C", "c", "SUCCEEDED", "c0", 295, 300, 500),
    ]
    names = "task_attempt_id string, task_id string, vertex_id string, vertex_name string, status string, creation_causal_ta string, creation_time long, start_time long, end_time long"
    facts = spark.createDataFrame(facts, names).withColumn("dag_id", F.lit("d"))
    edges = spark.createDataFrame([("d", "A", "B"), ("d", "B", "C")], "dag_id string, source_vertex string, destination_vertex string")
    events = spark.createDataFrame([("B", "a0", 100), ("C", "b0", 200), ("C", "b1", 400)], "vertex_id string, source_ta string, at_ms long")
    return facts, edges, events, spark.createDataFrame([("d", 5, 520)], "dag_id string, start_time long, end_time long")


def test_critical_path_by_data_has_all_reasons(spark):
    facts, edges, events, dags = history(spark)
    got = sorted(tuple(r)[1:] for r in analyzers.critical_path_by_data(facts, events, edges, dags).collect())
    assert got == [
        (0, "DAG_COMMIT", "c1", "COMMIT", 500, 520), (1, "ATTEMPT", "c1", "DATA", 400, 500), (2, "ATTEMPT", "b1", "OUTPUT_RECREATE", 300, 400), (3, "ATTEMPT", "c0", "DATA", 200, 300),
        (4, "ATTEMPT", "b0", "DATA", 100, 200), (5, "ATTEMPT", "a0", "INIT", 10, 100), (6, "VERTEX_INIT", "a0", "INIT", 5, 10),
    ]
    # without data after its creation, an attempt waited for the one it retries
    got = sorted(tuple(r)[1:] for r in analyzers.critical_path_by_data(facts, events.where("at_ms < 300"), edges, dags).collect())
    assert got[1:3] == [(1, "ATTEMPT", "c1", "RETRY", 290, 500), (2, "ATTEMPT", "c0", "DATA", 200, 290)]


def test_critical_walks_that_return(spark):
    facts, edges, events, dags = history(spark)
    loop = facts.withColumn("creation_causal_ta", F.when(F.col("task_attempt_id") == "c1", "c0").when(F.col("task_attempt_id") == "c0", "c1"))
    got = sorted(tuple(r)[1:] for r in analyzers.critical_path(loop, edges).collect())
    assert got == [(0, "c1", "RETRY"), (1, "c0", "RETRY"), (2, "c1", "LOOP")]
    assert analyzers.critical_path(facts.limit(0), edges).count() == 0 and analyzers.critical_path_by_data(facts.limit(0), events, edges, dags).count() == 0


def test_long_chains_are_walked_to_their_end(spark):
    n = 1500
    rows = [(f"a{i:05}", "t", "V", "v", "FAILED" if i < n - 1 else "SUCCEEDED", f"a{i - 1:05}" if i else None, i, i, i + 1, "d") for i in range(40)]
    facts = spark.createDataFrame(rows, "task_attempt_id string, task_id string, vertex_id string, vertex_name string, status string, creation_causal_ta string, creation_time long, start_time long, end_time long, dag_id string")
    none = spark.createDataFrame([], "dag_id string, source_vertex string, destination_vertex string")
    assert analyzers.critical_path(facts.where("task_attempt_id >= 'a00036'"), none).count() == 4
    chain = spark.range(n).select(F.lit("d").alias("dag_id"), F.format_string("v%05d", "id").alias("vertex_id"), F.lit(1).cast("long").alias("start_time"), F.lit(3).cast("long").alias("finish_time"))
    links = spark.range(n - 1).select(F.lit("d").alias("dag_id"), F.format_string("v%05d", "id").alias("source_vertex"), F.format_string("v%05d", F.col("id") + 1).alias("destination_vertex"))
    row = analyzers.vertex_critical_path(chain, links).first()
    assert row["score"] == 2 * n and row["path"].count(">") == n - 1
    with pytest.raises(Exception, match="cycle"):
        analyzers.vertex_critical_path(chain, links.unionByName(links.limit(1).select("dag_id", F.lit("v01499").alias("source_vertex"), F.lit("v00000").alias("destination_vertex")))).collect()
