"""Partition, total, secondary and top-k orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomflow.operators.running import running_sum
from loomflow.runtime import materialize


def partition_sort(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows hashed by key and sorted within each partition: sorted output per writer, no global order."""
    spread = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return spread.sortWithinPartitions(*keys)


def total_sort(df: DataFrame, keys: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """Global order by sampled ranges; partition i holds nothing greater than partition i + 1."""
    if partitions:
        return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return df.orderBy(*keys)


def secondary_sort(df: DataFrame, group: str, second: str) -> DataFrame:
    """Rows grouped by ``group``, within it by ``second``: partitioned and sorted, never collected."""
    return df.repartition(group).sortWithinPartitions(group, second)


def secondary_sort_separated(df: DataFrame, group: str, second: str) -> DataFrame:
    """``secondary_sort`` with a row before each group that separates it from the one before: (``group``,
    ``second`` null there, ``separator``). A group's rows stay in one partition, in order."""
    rows = df.select(group, second, F.lit(False).alias("separator"))
    marks = df.select(group).distinct().select(group, F.lit(None).cast(df.schema[second].dataType).alias(second), F.lit(True).alias("separator"))
    both = rows.unionByName(marks)
    return both.repartition(group).sortWithinPartitions(group, F.col("separator").desc(), second)


def with_positions(df: DataFrame, out: str = "position") -> DataFrame:
    """``df`` with each row's place in the order in which its partitions follow one another, from 1: shows what a
    sort put where. Rows are kept as a table, so both looks at them see one order."""
    numbered = materialize(df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "positions")
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = numbered.join(F.broadcast(offsets), "__part")
    return placed.withColumn(out, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__before")


def secondary_rank(df: DataFrame, group: str, second: Sequence[str]) -> DataFrame:
    """``secondary_sort`` with the place of each row in its group (``rank_no``). Duplicates get places of
    their own. A group too large for one task is ranked in ranges; see ``running``."""
    return running_sum(df, [group], second, F.lit(1), "rank_no").withColumn("rank_no", F.col("rank_no").cast("int"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order: each task keeps k rows, then they merge. Name columns
    enough to break ties. Gives exactly k rows where there are so many."""
    return df.orderBy(*order).limit(k)


def byte_order(column: str) -> Column:
    """Sort column of a text's byte order."""
    return F.encode(F.col(column), "UTF-8")
