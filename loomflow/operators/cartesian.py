"""Cartesian products, the one family whose result is all pairs by definition."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.runtime import materialize

#: Defaults of the fair product: most parallel tasks, least pairs a task.
MOST_TASKS = 1000
LEAST_PAIRS = 1_000_000


def cartesian(sources: Sequence[DataFrame], pids: Sequence[tuple[str, Column]] | None = None, keep: Callable[..., Column] | None = None) -> DataFrame:
    """n-ary product of sources with distinct column names.

    ``pids`` names a partition id per source, ``keep`` is a predicate over these ids that
    picks combinations. The combinations of ids that occur are made and picked first, a table of as many rows
    as partitions have combinations, and the sources are joined to it by their ids one after the
    other: rows of combinations that are not kept are never paired. A null id is one more id.
    """
    if keep is None or not pids:
        out = sources[0]
        for s in sources[1:]:
            out = out.crossJoin(s.hint("shuffle_replicate_nl"))
        return out
    names = [name for name, _ in pids]
    sources = [s.withColumn(name, expr) for s, (name, expr) in zip(sources, pids)]
    kept = sources[0].select(names[0]).distinct()
    for s, name in zip(sources[1:], names[1:]):
        kept = kept.crossJoin(s.select(name).distinct())
    out = materialize(kept.where(keep(*map(F.col, names))), "combinations").withColumnsRenamed({n: f"__{n}" for n in names})
    for s, name in zip(sources, names):
        out = out.join(s, F.col(f"__{name}").eqNullSafe(F.col(name))).drop(name, f"__{name}")
    return out


def filtered_cross(left: DataFrame, right: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """(l, r) of every row of ``left`` whose key is in ``keep``, and every distinct row of ``right``."""
    return left.join(keep.select(on).distinct(), on, "left_semi").crossJoin(right.distinct())


def distinct_cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().crossJoin(right.distinct())


def fair_chunks(records: Sequence[int], most: int = MOST_TASKS, least: int = LEAST_PAIRS) -> list[int]:
    """Chunks per source of a fair product: tasks = min(most, ceil(pairs / least)), chunks in
    proportion to the records, a source below two chunks gets one. An empty source means no task."""
    if any(r == 0 for r in records):
        return [0] * len(records)
    pairs = math.prod(records)
    tasks = min(most, -(-pairs // least))
    chunks, left, open_sources = [1] * len(records), float(tasks), sorted(range(len(records)), key=lambda i: records[i])
    for k, i in enumerate(open_sources):
        rest = open_sources[k:]
        mean = math.prod(records[j] for j in rest) ** (1 / len(rest))
        share = left ** (1 / len(rest)) * records[i] / mean
        chunks[i] = max(1, int(share + 1e-9)) if share >= 2 else 1
        left /= chunks[i]
    return chunks


def fair_cartesian(left: DataFrame, right: DataFrame, most: int = MOST_TASKS, least: int = LEAST_PAIRS) -> DataFrame:
    """Product of two sources in chunks of about equal numbers of pairs; empty if a source is empty."""
    a, b = fair_chunks([left.count(), right.count()], most, least)
    if not a:
        return left.limit(0).crossJoin(right.limit(0))
    return left.repartition(a).crossJoin(right.repartition(b).hint("shuffle_replicate_nl"))
