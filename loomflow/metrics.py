"""Row counters of running plans, without a second pass, and call-backs around jobs and tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows (``n_rows``) and the given aggregates while an action runs; read
    them from the observation's ``get`` after it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in metrics.items()]), seen


@contextmanager
def job_hooks(name: str, on_start: Callable[[str], None] | None = None, on_stop: Callable[[str, float, BaseException | None], None] | None = None) -> Iterator[None]:
    """Calls ``on_start(name)`` before and ``on_stop(name, seconds, error)`` after the actions in its body, failed ones too."""
    if on_start:
        on_start(name)
    began, error = time.monotonic(), None
    try:
        yield
    except BaseException as e:
        error = e
        raise
    finally:
        if on_stop:
            on_stop(name, time.monotonic() - began, error)


def task_hooks(df: DataFrame, on_start: Callable[[int], None], on_stop: Callable[[int, int], None]) -> DataFrame:
    """``df`` whose tasks call ``on_start(partition)`` before their first row and ``on_stop(partition, rows)`` after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, rows = TaskContext.get().partitionId(), 0
        on_start(partition)
        try:
            for batch in batches:
                rows += batch.num_rows
                yield batch
        finally:
            on_stop(partition, rows)

    return df.mapInArrow(run, df.schema)
