"""Semi, intersecting, validating and composite joins on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest build side that is broadcast, in rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def hash_semi_join(stream: DataFrame, build: DataFrame, on: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Rows of ``stream`` whose key occurs in ``build``: duplicates of the stream stay, those of
    the build side don't multiply, null keys never match.

    Both sides are hashed by key; with ``broadcast`` the distinct keys of the build
    side go to every task if they are at most BROADCAST_ROWS, which is counted first.
    """
    keys = build.select(*on).distinct()
    if broadcast and keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return stream.join(F.broadcast(keys), list(on), "left_semi")
    return stream.join(build.select(*on).hint("shuffle_hash"), list(on), "left_semi")


def intersect_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys that both sides have, each once, by a merge of sorted distinct keys; nulls never match."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b.hint("merge"), list(on), "left_semi")


def key_differences(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(keys..., side `left` or `right`): keys that one side lacks, duplicates ignored, nulls a key."""
    a = left.select(*on, F.lit(1).alias("__l"), F.lit(0).alias("__r"))
    b = right.select(*on, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    both = a.unionByName(b).groupBy(*on).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return both.where("__l + __r = 1").select(*on, F.when(F.col("__l") == 1, "left").otherwise("right").alias("side"))


def validate_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row (n_mismatch, valid): whether both sides have the same distinct keys."""
    counts = key_differences(left, right, on).agg(F.count(F.lit(1)).alias("n_mismatch"))
    return counts.select("n_mismatch", (F.col("n_mismatch") == 0).alias("valid"))


def composite_join(sources: Sequence[DataFrame], on: str, value: str, op: str = "inner") -> DataFrame:
    """n-way join of keyed sources.

    ``inner`` and ``outer`` give (key, value_0, ..., value_n): per key the cross product of
    the sources' values, with nulls for a source that lacks the key under ``outer``.
    ``override`` gives (key, source, value): all values of the last source that has the key.
    Null keys are left out. Tables bucketed by the key join without a shuffle.
    """
    if op == "override":
        tagged = [s.select(F.col(on), F.lit(i).alias("source"), F.col(value).cast("string").alias("value")) for i, s in enumerate(sources)]
        rows = tagged[0]
        for t in tagged[1:]:
            rows = rows.unionByName(t)
        rows = rows.where(F.col(on).isNotNull())
        # the winner per key is an aggregate: a key's rows are never gathered or sorted
        winner = rows.groupBy(on).agg(F.max("source").alias("source"))
        return rows.join(winner, [on, "source"], "left_semi").select(on, "source", "value")
    if op not in ("inner", "outer"):
        raise ValueError("op is inner, outer or override")
    parts = [s.where(F.col(on).isNotNull()).select(F.col(on), F.col(value).alias(f"value_{i}")) for i, s in enumerate(sources)]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(p, on, "inner" if op == "inner" else "full_outer")
    return joined


def broadcast_one_to_one_sum(own: DataFrame, shared: DataFrame, value: str, shared_value: str, result: str) -> DataFrame:
    """Each row's value plus the sum of all values of ``shared``: a scalar subquery, one row."""
    total = shared.agg(F.coalesce(F.sum(shared_value), F.lit(0))).scalar()
    return own.withColumn(result, F.col(value) + total)

