"""Sources, sinks, generators, history logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomflow.history import readers
from loomflow.operators import joins
from loomflow.sources import custom, generators, sinks
from loomflow.sources import text as texts
from loomflow.streaming import incremental, windows


def test_offsets(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é1\r\nword\n\nlast".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x\ny\n")
    got = {(r.file.rsplit("/", 1)[1], r.offset, r.line) for r in texts.read_lines_with_offsets(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {("a.txt", 0, "é1"), ("a.txt", 5, "word"), ("a.txt", 10, ""), ("a.txt", 11, "last"), ("c.txt", 0, "x"), ("c.txt", 2, "y")}
    assert texts.read_lines(spark, f"{tmp_path}/c.txt").count() == 2


def test_container_log_split(spark):
    lines = ["junk", "Container: c1 on n1", "LogType:stderr", "oops", "LogType:stdout", "fine", "Container: c2 on n2", "LogType:syslog", "x"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, no int, line string")
    got = [(r.line, r.container, r.node, r.log_type) for r in texts.split_container_log(df, ["no"]).orderBy("no").collect()]
    assert got == [("junk", None, None, None), ("oops", "c1", "n1", "stderr"), ("fine", "c1", "n1", "stdout"), ("x", "c2", "n2", "syslog")]


def test_generators(spark):
    big, small, both = generators.join_data(spark, 100, 30, 0.2, seed=1)
    assert (big.distinct().count(), small.distinct().count(), both.count()) == (100, 30, 20)
    assert joins.validate_keys(joins.intersect_keys(big, small, ["value"]), both, ["value"]).first()["valid"]
    assert generators.join_data(spark, 100, 30, 0.2, seed=1)[0].collect() == big.collect()
    row = generators.random_bytes(spark, 3, key_bytes=7, value_bytes=70).first()
    assert (len(row.key), len(row.value)) == (7, 70)
    assert all(5 <= len(r.key.split(" ")) <= 10 for r in generators.random_text(spark, 20).collect())


def test_custom_source(spark):
    custom.register(spark)
    df = spark.read.format("terms").option("rows", 10).option("splits", 3).load()
    assert sorted(r.value for r in df.collect()) == sorted(f"term{i}" for i in range(10)) and df.rdd.getNumPartitions() == 3


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    sinks.write_new(df, f"{tmp_path}/one")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_new(df, f"{tmp_path}/one")
    sinks.write_dynamic(df, f"{tmp_path}/dyn", "g")
    assert spark.read.parquet(f"{tmp_path}/dyn/g=1").count() == 5
    sinks.write_group([df, df], f"{tmp_path}/group")
    assert spark.read.parquet(f"{tmp_path}/group").count() == 20
    broken = df.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_all({f"{tmp_path}/p": df, f"{tmp_path}/q": broken})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dyn", "group", "one"]  # neither of both
    sinks.write_all({f"{tmp_path}/p": df, f"file:{tmp_path}/q": df})
    assert spark.read.parquet(f"{tmp_path}/q").count() == 10
    with pytest.raises(FileExistsError):
        sinks.write_all({f"{tmp_path}/p": df})


def test_second_move_fails(spark, tmp_path, monkeypatch):
    """Both outputs are staged, the second can't be moved into place: neither is left."""
    df, moved = spark.range(3), []
    real = sinks.files_of

    class Failing:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def move(self, a, b):
            moved.append(b)
            if len(moved) == 2:
                raise OSError("no")
            self.files.move(a, b)

    def files_of(spark, path):
        files, at = real(spark, path)
        return Failing(files), at

    monkeypatch.setattr(sinks, "files_of", files_of)
    with pytest.raises(OSError, match="no"):
        sinks.write_all({f"{tmp_path}/a": df, f"{tmp_path}/b": df})
    assert len(moved) == 2 and list(tmp_path.iterdir()) == []


def event(kind, at, attempt, **data):
    return {"event_type": kind, "event_time": at, "dag_id": "d", "vertex_id": "v", "task_id": "t", "task_attempt_id": attempt, "event_data": data}


def test_history_round_trip(spark, tmp_path):
    rows = [event("ATTEMPT_STARTED", 100, "a1", node_id="n1"), event("ATTEMPT_FINISHED", 250, "a1", status="SUCCEEDED", **{"counter.G.N": "7", "counter.G.bad": "x"}), event("ATTEMPT_STARTED", 86_400_300, "a2")]
    (tmp_path / "log.json").write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n")
    events = readers.read_events(spark, f"{tmp_path}/log.json")
    attempts = {r.task_attempt_id: r for r in readers.attempts_from_events(events).collect()}
    assert (attempts["a1"].time_taken, attempts["a1"].status, attempts["a1"].node_id, attempts["a2"].end_time) == (150, "SUCCEEDED", "n1", None)
    assert [tuple(r) for r in readers.counters_from_events(events).collect()] == [("a1", "G", "N", 7)]
    readers.write_events(events, f"{tmp_path}/dated")
    assert sorted(p.name for p in (tmp_path / "dated").iterdir() if p.is_dir()) == ["date=1970-01-01", "date=1970-01-02"]
    assert readers.read_events(spark, f"{tmp_path}/dated", "parquet").count() == 3
    readers.write_nowhere(events)


def test_entities(spark, tmp_path):
    line = {"entity": "e1", "entitytype": "TASK", "starttime": 5, "events": [{"eventtype": "S", "timestamp": 5}, {"eventtype": "F", "timestamp": 9}], "otherinfo": {"k": "v"}}
    (tmp_path / "e.json").write_text(json.dumps(line) + "\n" + json.dumps({"entity": "e2", "entitytype": "TASK"}))
    got = sorted((r.entity, r.event_type or "", r.event_time) for r in readers.read_entities(spark, f"{tmp_path}/e.json").collect())
    assert got == [("e1", "F", 9), ("e1", "S", 5), ("e2", "", None)]


def test_incremental_scan_sees_each_file_once(spark, tmp_path):
    seen = []
    handle = lambda batch, number: seen.extend(r.id for r in batch.collect())
    for k in (1, 2):
        spark.range(k * 10, k * 10 + 3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/date={k}")
        assert incremental.scan_new(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/state", handle) == 3
    assert sorted(seen) == [10, 11, 12, 20, 21, 22]
    incremental.follow(spark, f"{tmp_path}/in/date=1", "id long", f"{tmp_path}/s2", f"{tmp_path}/out", lambda d: d.where("id > 10"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_stream_windows_drop_late_events(spark, tmp_path):
    def write(*times):
        spark.createDataFrame([(t, t) for t in times], "id string, ts string").select("id", F.col("ts").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def count():
        stream = windows.event_time(spark.readStream.schema("id string, ts timestamp_ntz").parquet(f"{tmp_path}/in"), "ts", "10 minutes")
        wide = windows.windowed(windows.first_deliveries(stream, ["id"]), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")])
        wide.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    write("2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 00:20:00")
    count()
    write("2024-01-01 03:00:00")
    count()
    write("2024-01-01 00:30:00")  # too late
    count()
    assert [(str(r.window_start), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("2024-01-01 00:00:00", 2)]


def test_bucketed_tables_join_without_a_shuffle(spark, plan):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"drop table if exists {name}")
            sinks.write_bucketed(df, name, "k", 4)
        joined = joins.composite_join([spark.table("bucketed_a"), spark.table("bucketed_b")], "k", "v")
        assert joined.count() == 800
        assert "Exchange" not in plan(joined).split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_are_pruned_at_run_time(spark, tmp_path, plan):
    spark.range(400).select((F.col("id") % 8).alias("day"), "id").write.partitionBy("day").parquet(f"{tmp_path}/facts")
    spark.range(8).select(F.col("id").alias("d"), F.concat(F.lit("n"), "id").alias("name")).write.parquet(f"{tmp_path}/days")
    joined = spark.read.parquet(f"{tmp_path}/facts").join(spark.read.parquet(f"{tmp_path}/days").where("name = 'n3'"), F.col("day") == F.col("d"))
    assert joined.count() == 50 and "dynamicpruning" in plan(joined).lower()


def test_sequence_files(spark, tmp_path):
    spark.sparkContext.parallelize([("a", "1"), ("b", "2")]).saveAsSequenceFile(f"{tmp_path}/seq")
    assert sorted(map(tuple, texts.read_sequence_files(spark, f"{tmp_path}/seq").collect())) == [("a", "1"), ("b", "2")]


def test_prewarm(spark):
    from loomflow.runtime import prewarm

    assert prewarm(spark) == 4


def test_custom_sink_commits_all_or_nothing(spark, tmp_path):
    from loomflow.sources import custom

    custom.register(spark)
    df = spark.range(0, 20, 1, 3).select(F.concat(F.lit("é"), F.col("id")).alias("value"))
    df.write.format("lines").mode("append").save(f"{tmp_path}/out")
    df.limit(2).write.format("lines").mode("append").save(f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted([f"é{i}" for i in range(20)] + ["é0", "é1"])
    bad = df.select(F.when(F.col("value") != "é19", F.col("value")).otherwise(F.raise_error(F.lit("no"))).alias("value"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("lines").mode("append").save(f"{tmp_path}/none")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    df.limit(1).write.format("lines").mode("overwrite").save(f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 1


def test_lines_cut_by_ranges(spark, tmp_path, monkeypatch):
    content = "".join(f"{'x' * (i * 7 % 23)}{i}\n" for i in range(300)) + "last"
    (tmp_path / "f.txt").write_text(content)
    want, at = [], 0
    for line in content.split("\n"):
        want.append((at, line))
        at += len(line) + 1
    for width in (1, 10, 64, 10_000):
        monkeypatch.setattr(texts, "RANGE_BYTES", width)
        got = sorted((r.offset, r.line) for r in texts.read_lines_with_offsets(spark, f"{tmp_path}/f.txt").collect())
        assert got == want
