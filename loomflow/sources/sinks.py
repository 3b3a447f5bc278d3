"""Sinks: refuse to overwrite, dynamic paths, several outputs that appear together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.runtime import exists, files_of


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes to a path that must not exist."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_dynamic(df: DataFrame, path: str, by: str, kind: str = "parquet") -> None:
    """A folder per value of ``by``; a value's rows come from one shuffle partition or, where they
    are many, several, so few files are written and no task holds a hot value."""
    df.hint("rebalance", by).write.mode("errorifexists").partitionBy(by).format(kind).save(path)


def write_all(outputs: dict[str, DataFrame], per_output: bool = False, kind: str = "parquet") -> None:
    """Several sinks of one job. By default all are staged first and moved into place only when
    every one has succeeded; if a write or a move fails, outputs already moved are taken away
    again, so a failure leaves none of them. With ``per_output`` each
    appears as soon as it is written. Moves are renames, not one atomic step."""
    spark = next(iter(outputs.values())).sparkSession
    for path in outputs:
        if exists(spark, path):
            raise FileExistsError(path)
    if per_output:
        for path, df in outputs.items():
            write_new(df, path, kind)
        return
    staged = {path: f"{path.rstrip('/')}.__staged-{uuid.uuid4().hex}" for path in outputs}
    try:
        for path, df in outputs.items():
            write_new(df, staged[path], kind)
        moved: list[str] = []
        try:
            for path, stage in staged.items():
                files, at = files_of(spark, path)
                files.move(files_of(spark, stage)[1], at)  # raises if it fails
                moved.append(path)
        except BaseException:
            for path in moved:
                files, at = files_of(spark, path)
                files.delete_dir(at)
            raise
    finally:
        for stage in staged.values():
            if exists(spark, stage):
                files, at = files_of(spark, stage)
                files.delete_dir(at)


def write_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> None:
    """A table bucketed and sorted by a key: tables of equal buckets join on it without a shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(name)


def write_group(sources: list[DataFrame], path: str, kind: str = "parquet") -> None:
    """One sink shared by a group of sources."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    write_new(out, path, kind)


def write_dated(events: DataFrame, path: str, time_ms: str, kind: str = "parquet") -> None:
    """Appends events to folders by UTC day (``date=yyyy-mm-dd``)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"cast(floor({time_ms} / 86400000) as int)"))
    events.withColumn("date", day).write.mode("append").partitionBy("date").format(kind).save(path)

