"""Running sums and previous values per key, also where one key holds much of the data.

A window runs each key in one task. Where a key has more rows than LARGEST_GROUP, rows are
cut into ranges of (key, order) instead, windows run within ranges, and what a range
needs from those before it (at most two rows a range) is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomflow.runtime import materialize

#: Rows of one key that one task may order.
LARGEST_GROUP = 5_000_000


def _largest(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``__range``, rising with (keys, order); kept as a table, so it is the same for every use."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins what earlier ranges leave to a (key, range); only keys cut by a range's border have any."""
    renamed = carry.select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("__range").alias("__c_range"), "__carry")
    match = F.col("__range") == F.col("__c_range")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    return rows.join(F.broadcast(renamed), match, "left").drop("__c_range", *[f"__c_{k}" for k in keys])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over a key's rows up to each row in ``order``, which should be
    unique within a key. Null keys are a key; an empty table gives no rows."""
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if _largest(df, keys) <= LARGEST_GROUP:
        return df.withColumn(out, F.sum(value).over(upto(*keys)))
    rows = _ranges(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    carry = sums.withColumn("__carry", F.sum("__sum").over(before)).where("__carry is not null")
    own = rows.withColumn(out, F.sum(value).over(upto(*keys, "__range")))
    joined = _with_carry(own, carry, keys)
    return joined.withColumn(out, F.col(out) + F.coalesce("__carry", F.lit(0))).drop("__carry", "__range")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the value of the row before in its key, null for a key's first row; otherwise as ``running_sum``."""
    before = lambda *by: Window.partitionBy(*by).orderBy(*order)
    if _largest(df, keys) <= LARGEST_GROUP:
        return df.withColumn(out, F.lag(value).over(before(*keys)))
    rows = _ranges(df, keys, order)
    last = rows.groupBy(*keys, "__range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    carry = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range"))).where("__carry is not null")
    inside = before(*keys, "__range")
    own = rows.withColumn(out, F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    joined = _with_carry(own, carry, keys)
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__carry")[value]).otherwise(F.col(out))).drop("__carry", "__range", "__first")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with nulls of ``columns`` filled by the last value before them in their key; otherwise as ``running_sum``."""
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if _largest(df, keys) <= LARGEST_GROUP:
        return df.withColumns({c: F.last(c, ignorenulls=True).over(upto(*keys)) for c in columns})
    rows = _ranges(df, keys, order)
    last = rows.groupBy(*keys, "__range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "__range", F.struct(*[F.last(c, ignorenulls=True).over(before).alias(c) for c in columns]).alias("__carry"))
    own = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto(*keys, "__range")) for c in columns})
    joined = _with_carry(own, carry, keys)
    return joined.withColumns({c: F.coalesce(c, F.col("__carry")[c]) for c in columns}).drop("__carry", "__range")
