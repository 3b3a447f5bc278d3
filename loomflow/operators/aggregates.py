"""Grouped results beyond plain aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each group's first row by ``order`` (which should be unique): an aggregate, no sort."""
    least = F.min_by(F.struct(*values), F.struct(*order)).alias("v")
    return df.groupBy(*keys).agg(least).select(*keys, "v.*")


def counter_summary(counters: DataFrame) -> DataFrame:
    """(counter_group, counter_name, total, least, most) of (counter_group, counter_name, value)."""
    return counters.groupBy("counter_group", "counter_name").agg(F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def broadcast_sum(values: DataFrame, value: str, consumers: DataFrame) -> DataFrame:
    """Every consumer row with the sum and count of all values: two scalars, no join."""
    total = values.agg(F.sum(value)).scalar()
    count = values.agg(F.count(value)).scalar()
    return consumers.select("*", total.alias("value_sum"), count.alias("value_count"))


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's map over Arrow batches."""
    return df.mapInPandas(lambda parts: (function(p) for p in parts), schema)


def reduce_groups(df: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's reducer over whole groups; a group must fit in a task, else aggregate first."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def combine_and_reduce(df: DataFrame, keys: Sequence[str], combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``combine`` runs on every Arrow batch before the shuffle and on what each group's
    partial results are after it, so a hot group is small when it meets. It must give
    the same columns it takes, as a combiner does."""
    columns = [*df.columns]
    partial = df.mapInPandas(lambda parts: (combine(p)[columns] for p in parts), schema)
    return partial.groupBy(*keys).applyInPandas(lambda group: combine(group)[columns], schema)
