"""Percentiles per group over very large numeric columns from mergeable sketches.

A sketch is a stack of relative-rank compactors. Level h holds values that each
stand for 2**h input values. A full compactor sorts its buffer, protects the
largest values and sends every second one of the lower part to the level above,
so ranks near the top are exact or nearly so and the error of a rank grows with
its distance from the top. Sketches of partitions or days merge level by level.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.runtime import ship

#: Section size. The rank error of share q of n values stays within (n - q n) / section + 1. That is measured, not
#: proven, since the coins are no random ones: tests/llm/test_quantiles.py has the stress runs.
SECTION = 64

#: Values a map task keeps over all its sketches before it hands them on.
HELD_VALUES = 2_000_000

#: Neighbouring tasks whose sketches of a key meet first; what they give meets next.
FAN_IN = 256


class RankSketch:
    """One mergeable sketch of float64 values (integers up to 2**53 stay exact)."""

    __slots__ = ("buffers", "count", "section", "states")

    def __init__(self, section: int = SECTION) -> None:
        self.section, self.count = section, 0
        self.buffers: list[list[np.ndarray]] = [[]]
        self.states: list[int] = [0]

    def capacity(self) -> int:
        sections = max(3, math.ceil(math.log2(max(self.count / self.section, 2))))
        return 2 * self.section * sections

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.count += len(values)
            self.buffers[0].append(np.asarray(values, dtype=np.float64))
            self._compress()

    def merge(self, other: RankSketch) -> None:
        self.count += other.count
        while len(self.buffers) < len(other.buffers):
            self.buffers.append([])
            self.states.append(0)
        for h, parts in enumerate(other.buffers):
            self.buffers[h].extend(parts)
            self.states[h] |= other.states[h]
        self._compress()

    def held(self) -> int:
        return sum(len(p) for parts in self.buffers for p in parts)

    def _compress(self) -> None:
        capacity, h = self.capacity(), 0
        while h < len(self.buffers):
            size = sum(map(len, self.buffers[h]))
            if size > capacity:
                self._compact(h, size, capacity)
            h += 1

    def _compact(self, h: int, size: int, capacity: int) -> None:
        """Halve all but the protected top. Sections next to the protected half are
        reached on every 2nd, 4th, ... compaction only, which keeps the error relative."""
        values = np.sort(np.concatenate(self.buffers[h]))
        state = self.states[h]
        open_sections = min((~state & (state + 1)).bit_length(), capacity // 2 // self.section)
        lower = (size - capacity + open_sections * self.section) & ~1
        coin = (state ^ (state >> 1) ^ h) & 1  # alternates: a sketch of the same data is the same
        if h + 1 == len(self.buffers):
            self.buffers.append([])
            self.states.append(0)
        self.buffers[h + 1].append(values[:lower][coin::2])
        self.buffers[h] = [values[lower:]]
        self.states[h] = state + 1

    def quantiles(self, shares: Sequence[float]) -> list[float | None]:
        """Per share q the smallest held value that at least q of the values don't exceed."""
        if not self.count:
            return [None] * len(shares)
        values = np.concatenate([p for parts in self.buffers for p in parts])
        weights = np.concatenate([np.full(len(p), 1 << h, dtype=np.int64) for h, parts in enumerate(self.buffers) for p in parts])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        targets = [min(max(math.ceil(q * self.count - 1e-9), 1), self.count) for q in shares]
        return values[order][np.searchsorted(ranks, targets)].tolist()

    def to_bytes(self) -> bytes:
        levels = [np.concatenate(p) if p else np.empty(0) for p in self.buffers]
        head = struct.pack("<IQI", self.section, self.count, len(levels))
        return head + b"".join(struct.pack("<QI", s, len(v)) for s, v in zip(self.states, levels)) + b"".join(v.tobytes() for v in levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        section, count, n = struct.unpack_from("<IQI", data)
        sketch, at = cls(section), 16 + 12 * n
        sketch.count, sketch.buffers, sketch.states = count, [], []
        for h in range(n):
            state, length = struct.unpack_from("<QI", data, 16 + 12 * h)
            sketch.buffers.append([np.frombuffer(data, dtype=np.float64, count=length, offset=at)] if length else [])
            sketch.states.append(state)
            at += 8 * length
        return sketch


def _names(keys: Sequence[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def _schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    fields = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType([*fields, T.StructField("__n", T.LongType()), T.StructField("__sketch", T.BinaryType())])


def _emit(batch_keys: list[tuple], sketches: list[RankSketch], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in batch_keys], type=arrow.field(i).type) for i in range(len(arrow) - 2)]
    columns += [pa.array([s.count for s in sketches], pa.int64()), pa.array([s.to_bytes() for s in sketches], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def sketch_by(df: DataFrame, keys: Sequence[str], value: str, section: int = SECTION) -> DataFrame:
    """Partial sketches: (keys..., ``n`` long, ``sketch`` binary), several rows per key.

    Each map task sketches its own rows, so a key with a third of all rows is
    spread like the rows are. Null values and NaN don't count; null keys are a
    key of their own; a task that holds more than HELD_VALUES values hands its
    sketches on and starts anew, so millions of keys fit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    names = _names(keys)
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__v"))
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    schema = _schema(rows, names)
    arrow, width = to_arrow_schema(schema), len(names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, RankSketch] = {}
        fresh = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, lookups = np.zeros(batch.num_rows, np.int64), []
            for i in range(width):
                encoded = batch.column(i).dictionary_encode(null_encoding="encode")
                lookups.append(encoded.dictionary.to_pylist())
                codes = codes * len(lookups[-1]) + encoded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            values = batch.column(width).to_numpy(zero_copy_only=False)[order]
            bounds = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                code, key = int(codes[order[start]]), []
                for lookup in reversed(lookups):
                    code, at = divmod(code, len(lookup))
                    key.append(lookup[at])
                held.setdefault(tuple(reversed(key)), RankSketch(section)).add(values[start:end])
            fresh += batch.num_rows
            if fresh > HELD_VALUES:
                fresh = sum(s.held() for s in held.values())
                if fresh > HELD_VALUES // 2:
                    yield _emit(list(held), list(held.values()), arrow)
                    held, fresh = {}, 0
        if held:
            yield _emit(list(held), list(held.values()), arrow)

    out = rows.mapInArrow(build, schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("__n").alias("n"), F.col("__sketch").alias("sketch"))


def merge_sketches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per key from any number of sketches (of partitions, days, tables).

    ``df`` has the keys, ``n`` and ``sketch``. Sketches meet in two steps, those of FAN_IN
    neighbouring tasks first, so no task reads all sketches that tasks have of a hot key, or of a column
    without keys; one key's are merged as they stream by. A sketch is 66 KB of
    10^5 values and 233 KB of 2 x 10^7 with a section of 64, 156 and 724 KB with one of 256.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    names = _names(keys)
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("n").alias("__n"), F.col("sketch").alias("__sketch"))
    schema = _schema(rows, names)
    arrow, width = to_arrow_schema(schema), len(names)
    rows = rows.where("__sketch is not null").withColumn("__part", F.expr(f"spark_partition_id() div {FAN_IN}"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        sketch: RankSketch | None = None
        keys_out: list[tuple] = []
        sketches: list[RankSketch] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for r in range(batch.num_rows):
                key = tuple(columns[i][r] for i in range(width))
                part = RankSketch.from_bytes(columns[-1][r])
                if sketch is None or key != current:
                    if sketch is not None:
                        keys_out.append(current)
                        sketches.append(sketch)
                        if len(sketches) >= 1000:
                            yield _emit(keys_out, sketches, arrow)
                            keys_out, sketches = [], []
                    current, sketch = key, part
                else:
                    sketch.merge(part)
        if sketch is not None:
            yield _emit([*keys_out, current], [*sketches, sketch], arrow)

    def met(part: DataFrame) -> DataFrame:
        return (part.sortWithinPartitions(*names) if names else part).select(*names, "__n", "__sketch").mapInArrow(join, schema)

    some = met(rows.repartition(*names, "__part"))
    out = met(some.repartition(*names) if names else some.repartition(1))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("__n").alias("n"), F.col("__sketch").alias("sketch"))


def sketch_quantiles(shares: Sequence[float], sketch: str = "sketch") -> Column:
    """Column of array<double>, one value per share, from a sketch column."""
    from pyspark.sql.pandas.functions import arrow_udf

    shares = tuple(shares)

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def evaluate(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else RankSketch.from_bytes(b).quantiles(shares) for b in column.to_pylist()], pa.list_(pa.float64()))

    return evaluate(F.col(sketch))


def group_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], section: int = SECTION) -> DataFrame:
    """Per key: ``n`` and one double column per named share (0..1).

    A share's value v satisfies |rank(v) - q n| <= (n - q n) / section + 1 (see SECTION); a key
    with fewer than 6 x section values is exact. An empty table gives no rows.
    """
    merged = merge_sketches(sketch_by(df, keys, value, section), keys)
    found = merged.withColumn("__q", sketch_quantiles(list(shares.values())))
    return found.select(*keys, "n", *[F.col("__q")[i].alias(name) for i, name in enumerate(shares)])
