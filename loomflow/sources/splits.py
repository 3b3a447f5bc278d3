"""How input is cut into tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

#: Defaults of grouped splits: least and most bytes a group, waves of tasks per slot.
LEAST_BYTES = 50 << 20
MOST_BYTES = 1 << 30
WAVES = 1.7


def group_count(total_bytes: int, slots: int, waves: float = WAVES, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> int:
    """Groups for an input: ``slots`` x ``waves``, but such that a group's mean is within the bounds."""
    if total_bytes <= 0:
        return 0
    wanted = max(1, int(slots * waves))
    mean = total_bytes / wanted
    if mean > most:
        return -(-total_bytes // most)
    if mean < least:
        return max(1, total_bytes // least)
    return wanted


def group_splits(splits: Sequence[tuple[int, str | None]], groups: int) -> list[list[int]]:
    """Indexes of (bytes, host) splits in about equal groups, splits of a host together where they fill one."""
    if not splits or groups < 1:
        return []
    target = sum(s for s, _ in splits) / groups
    order = sorted(range(len(splits)), key=lambda i: (splits[i][1] or "", i))
    out, held, size, host = [], [], 0, None
    for i in order:
        if held and (size + splits[i][0] > target * 1.001 and len(out) < groups - 1):
            out.append(held)
            held, size = [], 0
        host = splits[i][1]
        held.append(i)
        size += splits[i][0]
    return [*out, held] if held else out


def configure(spark: SparkSession, total_bytes: int, slots: int | None = None) -> int:
    """Sets the session's split size for an input of so many bytes; gives the number of groups."""
    slots = slots or spark.sparkContext.defaultParallelism
    groups = group_count(total_bytes, slots)
    if groups:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1 << 20, -(-total_bytes // groups))))
    return groups
