"""Unions of several sources and what they are checked with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(sources: Sequence[DataFrame], source: str | None = None) -> DataFrame:
    """All rows of all sources by column name; with ``source`` the source's number from 0 too."""
    out = None
    for i, s in enumerate(sources):
        part = s if source is None else s.withColumn(source, F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def union_concatenated(sources: Sequence[DataFrame], keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Groups of each source by itself: a key appears once per source that has it (column ``src``)."""
    return union_all([s.groupBy(*keys).agg(*aggs) for s in sources], "src")


def union_merged(sources: Sequence[DataFrame], keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Groups over all sources together: a key appears once."""
    return union_all(sources).groupBy(*keys).agg(*aggs)


def union_check(first: DataFrame, second: DataFrame, doubled: DataFrame, key: str) -> DataFrame:
    """One row (label `Union`, n_keys, n_wrong): distinct keys, and how many don't net to 0 when
    each of the first two sources adds one and the third takes two away."""
    sides = union_all([s.select(F.col(key)).distinct().withColumn("n", F.lit(n)) for s, n in ((first, 1), (second, 1), (doubled, -2))])
    net = sides.groupBy(key).agg(F.sum("n").alias("net"))
    return net.agg(F.lit("Union").alias("label"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("net") != 0).alias("n_wrong"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity, and ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
