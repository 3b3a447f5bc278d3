"""Tables in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from loomflow import runtime


def test_folder_is_the_sessions(spark):
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialize_cuts_lineage_and_keeps_the_schema(spark, plan):
    df = spark.range(5).select("id", F.lit(None).cast("string").alias("n"), F.array(F.col("id")).alias("a"))
    kept = runtime.materialize(df, "t")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.dtypes == df.dtypes
    assert "Range" not in plan(kept)
    assert runtime.materialize(df.limit(0), "t").count() == 0


def test_release_deletes_tables(spark):
    before = list(runtime._written)
    runtime._written.clear()
    runtime.materialize(spark.range(3), "gone")
    path = Path(runtime._written[0][1])
    assert path.exists()
    runtime.release()
    assert not path.exists()
    runtime._written.extend(before)


def test_command_line(spark, small, tmp_path, capsys):
    from loomflow.__main__ import main

    assert main(["list"]) == 0 and "word_count" in capsys.readouterr().out
    assert main(["run", "no_such_query", small]) == 2
    assert main(["run", "distinct_keys", small, f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["o_custkey"]
    assert main(["explain", "top_k", small]) == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        assert main(["--local", "--counters", "--group-splits", "run", "distinct_keys", small]) == 0
        assert f"rows: {spark.read.parquet(f'{tmp_path}/out').count()}" in capsys.readouterr().out
        assert main(["--split-bytes", "7000000", "explain", "top_k", small]) == 0 and spark.conf.get("spark.sql.files.maxPartitionBytes") == "7000000"
        assert main(["--split-bytes", "x", "explain", "top_k", small]) == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hooks(spark, tmp_path):
    from loomflow.metrics import job_hooks, task_hooks

    seen, folder = [], str(tmp_path)
    with job_hooks("a", lambda n: seen.append(("start", n)), lambda n, s, e: seen.append(("stop", n, s >= 0, e))):
        assert task_hooks(spark.range(0, 10, 1, 2), lambda p: Path(folder, f"{p}").touch(), lambda p, n: Path(folder, f"{p}").write_text(str(n))).count() == 10
    assert seen == [("start", "a"), ("stop", "a", True, None)]
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"0": "5", "1": "5"}
    error = ValueError("x")
    try:
        with job_hooks("b", None, lambda n, s, e: seen.append(e)):
            raise error
    except ValueError:
        assert seen[-1] is error
