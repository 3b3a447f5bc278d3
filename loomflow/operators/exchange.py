"""Movements of data between stages, by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.runtime import materialize


def scatter(df: DataFrame, keys: Sequence[str], partitions: int | None = None, sort: bool = False) -> DataFrame:
    """Rows with equal keys meet in one partition; with ``sort`` ordered by key inside it."""
    out = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return out.sortWithinPartitions(*keys) if sort else out


def round_robin(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions)


def broadcast_checked(df: DataFrame, most_rows: int = 1_000_000) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, and whether it is."""
    small = df.limit(most_rows + 1).count() <= most_rows
    return (F.broadcast(df) if small else df), small


def route(df: DataFrame, partition_id: Column, partitions: int) -> DataFrame:
    """Custom routing: every row goes to the partition its id names, 0 to ``partitions`` - 1."""
    return df.repartitionById(partitions, partition_id.cast("int"))


def first_key_id(first: Column, partitions: int) -> Column:
    """|first x 127| mod partitions."""
    return F.pmod(F.abs(first.cast("long") * 127), F.lit(partitions)).cast("int")


def char_id(text: Column, partitions: int = 2) -> Column:
    """Code of the first character mod partitions; null for null or empty texts."""
    return F.when(F.length(text) > 0, F.pmod(F.ascii(F.substring(text, 1, 1)), F.lit(partitions))).cast("int")


def modulo_id(number: Column, partitions: int) -> Column:
    return F.pmod(number.cast("long"), F.lit(partitions)).cast("int")


def by_range(df: DataFrame, keys: Sequence[str], partitions: int) -> DataFrame:
    """Total-order partitions from sampled cut points."""
    return df.repartitionByRange(partitions, *keys)


def durable(df: DataFrame, kind: str = "persisted") -> DataFrame:
    """How a source keeps its output: ``ephemeral`` is pipelined, ``persisted`` lives in shuffle files,
    ``reliable`` is written to the shared folder and survives the loss of any executor."""
    if kind == "reliable":
        return materialize(df, "durable")
    if kind in ("ephemeral", "persisted"):
        return df
    raise ValueError("kind is ephemeral, persisted or reliable")
