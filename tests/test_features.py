"""Features per entity from events."""

import pytest
from pyspark.sql import functions as F

from loomflow.operators.features import epoch_ms, event_statistics, feature_table, upper_words

MS = 1_704_000_000_123


def stats(spark, rows):
    df = spark.createDataFrame(rows, "id long, d string, t string, at long, s long, entity string, words string")
    return event_statistics(df, F.col("d"), F.col("t"), F.col("id"), F.col("at"), F.col("s"))


ROWS = [
    (1, "Dag_1 ", "TASK_DONE", MS, 5, "z", "z"),
    (1, "\tdag_1", "task.done", MS * 1000 + 7, 5, "z", "z"),  # a copy in microseconds
    (2, "dag_1", "Task-Done\t", MS // 1000, None, "z", "z"),
    (3, "dag_1", "taskdone", MS * 1_000_000 + 999_999, 7, "z", "z"),
    (4, "dag_1", "OTHER", 0, 1, "z", "z"), (5, "dag_1", " ", MS, 1, "z", "z"), (6, "", "OTHER", MS, 1, "z", "z"),
    (7, "dag_1", "OTHER", None, 1, "z", "z"), (None, "dag_1", "OTHER", MS, 1, "z", "z"), (8, None, "OTHER", MS, 1, "z", "z"),
    (9, "dag_2", "OTHER", MS, 2, "z", "z"),
]


def test_statistics(spark):
    assert sorted(map(tuple, stats(spark, ROWS).collect())) == [("dag_1", "TASK_DONE", 3, MS, 12), ("dag_2", "OTHER", 1, MS, 2)]


def test_feature_table_has_all_types(spark):
    got = {r["entity"]: r for r in feature_table(stats(spark, ROWS)).collect()}
    assert got["dag_1"]["types"] == got["dag_2"]["types"] == ["OTHER", "TASK_DONE"]
    assert (got["dag_1"]["counts"], got["dag_1"]["last_ms"], got["dag_1"]["sizes"]) == ([0, 3], [None, MS], [0, 12])
    assert got["dag_2"]["latest_ms"] == MS


def test_dense_arrays_in_slices(spark, monkeypatch):
    import loomflow.operators.features as module

    monkeypatch.setattr(module, "CELLS", 40)
    rows = [(i, f"d{i % 50}", f"T{i % 17}", MS + i, i, "z", "z") for i in range(1000)]
    df = stats(spark, rows)
    want = {(r.entity, r.eventtype): (r.n_events, r.last_ms, r.total_size) for r in df.collect()}
    for r in feature_table(df).collect():
        for t, n, last, size in zip(r["types"], r["counts"], r["last_ms"], r["sizes"]):
            assert want.get((r["entity"], t), (0, None, 0)) == (n, last, size)


def test_empty(spark):
    assert stats(spark, []).count() == 0
    assert feature_table(stats(spark, [])).count() == 0


def test_hot_entity(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 500)).alias("d"))
    got = event_statistics(df, F.col("d"), F.lit("X"), F.col("id"), F.lit(MS), F.lit(1), salts=8)
    assert got.where("entity = 'hot'").first()["n_events"] == 1334
    assert got.agg(F.sum("n_events")).first()[0] == 4000


@pytest.mark.parametrize(("value", "want"), [(None, None), (0, None), (-5, None), (1_704_000_000, 1_704_000_000_000), (MS, MS), (MS * 1000 + 999, MS), (MS * 10**6 + 1, MS)])
def test_epoch_ms(spark, value, want):
    assert spark.range(1).select(epoch_ms(F.lit(value).cast("long"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [(None, None), (" -- ", None), ("a--b", "A_B"), ("_x_", "X"), ("Ünï code9", "ÜNÏ_CODE9")])
def test_upper_words(spark, text, want):
    assert spark.range(1).select(upper_words(F.lit(text).cast("string"))).first()[0] == want
