"""Heavy keys: find them, aggregate per key in two salted stages, and join on
keys of which a few hold most rows.

All salts are hashes of row content, so a re-run task salts its rows alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.runtime import parallelism


def heavy_keys(df: DataFrame, keys: Sequence[str], per_partition: int = 4) -> DataFrame:
    """Keys (null-safe) holding at least 1/(``per_partition`` x shuffle partitions) of all rows.

    Counted over all rows with map-side combining, so a heavy key reaches the
    shuffle as one row per map task. At most ``per_partition`` x partitions keys
    qualify, which bounds the result whatever the data; it is safe to broadcast.
    Returns the keys with ``heavy_rows``. Empty input gives no rows.
    """
    return weighed_keys(df, keys, per_partition).drop("all_rows")


def weighed_keys(df: DataFrame, keys: Sequence[str], per_partition: int = 4) -> DataFrame:
    """``heavy_keys`` with ``all_rows``, the number of all rows."""
    slots = per_partition * parallelism(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("heavy_rows"))
    total = counts.agg(F.sum("heavy_rows")).scalar()
    return counts.where(F.col("heavy_rows") * slots >= total).withColumn("all_rows", total)


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    salt_by: Sequence[str],
    salts: int | None = None,
    heavy: DataFrame | None = None,
    else_by: Sequence[str] = (),
) -> DataFrame:
    """Two-stage aggregation per key: heavy keys get a salt, ``partial`` aggregates run per key and
    salt, ``merge[name](column)`` joins the partials per original key.

    A key gets as many salts as its rows would fill partitions, or ``salts`` of them. ``heavy``
    (keys, ``heavy_rows`` and ``all_rows``) may be what ``weighed_keys`` found on rows that are cheaper
    to read than ``df``; by default it is counted on ``df``.

    Null keys form a group of their own; an empty table gives no rows; repeated
    rows each count. Only ``keys``, ``salt_by``, ``else_by`` and the columns named inside
    ``partial`` are read; helper columns start with ``__`` so extra columns with
    other names never clash. ``salt_by`` should name columns that vary within a
    key; rows equal in them share a salt, so ``countDistinct`` of a salt column
    stays additive over salts. Rows that have nulls only in them are salted by ``else_by``.
    """
    found = weighed_keys(df, keys) if heavy is None else heavy
    partitions = parallelism(df.sparkSession)
    wanted = F.ceil(F.col("heavy_rows") * partitions / F.col("all_rows")) + 1 if salts is None else F.lit(salts)
    found = found.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.least(wanted, F.lit(1_000_000)).cast("int").alias("__salts"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    by = F.xxhash64(*salt_by)
    if else_by:
        filled = F.lit(False)
        for c in salt_by:
            filled = filled | F.col(c).isNotNull()
        by = F.when(filled, by).otherwise(F.xxhash64(*else_by))
    salt = F.coalesce(F.pmod(by, F.col("__salts")), F.lit(-1))
    marked = df.join(F.broadcast(found), match, "left").withColumn("__salt", salt.cast("int"))
    first = marked.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[f(n).alias(n) for n, f in merge.items()])


def hot_join(
    rows: DataFrame, state: DataFrame, keys: Sequence[str], weight: str, per_partition: int = 4, how: str = "inner"
) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-key ``state`` (keys null-safe), where
    ``state[weight]`` tells how many of ``rows`` a key has.

    Keys with at least 1/(``per_partition`` x partitions) of all weight are so few that
    their states are broadcast, and their rows never shuffle; the rest, none of
    which can overload a task, join by shuffle. The result has ``rows``' columns and
    those of ``state`` that aren't keys.
    """
    slots = per_partition * parallelism(rows.sparkSession)
    total = state.agg(F.sum(weight)).first()[0] or 0
    least = max(total // slots, 1)
    renamed = state.select(*[F.col(k).alias(f"__s_{k}") for k in keys], *[c for c in state.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    hot = renamed.where(F.col(weight) >= least)
    hot_names = hot.select(*[f"__s_{k}" for k in keys])
    drop = [f"__s_{k}" for k in keys]
    direct = rows.join(F.broadcast(hot), match).drop(*drop)
    rest = rows.join(F.broadcast(hot_names), match, "left_anti").join(renamed.where(F.col(weight) < least), match).drop(*drop)
    return direct.unionByName(rest)
