"""Continuous periods and gaps of overlapping, nested and gapped intervals.

Time is cut into exact half units, so that closed intervals that share an instant
join and neighbours that don't stay apart. Each interval sets bits lo..hi of its
entity's bitmap, kept per time shard of fixed width as compressed runs (start, length);
the shards that an interval covers whole are one run of shards, however many they are.
Map tasks unite their own rows' runs first, so an entity with a third of all rows
sends a bounded bitmap per shard and task; runs are united once more per shard, set
runs are the periods, clear runs between them the gaps, and only the first and last
runs of shards are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomflow.runtime import materialize, ship

#: A shard's width in time units (a day of milliseconds), whatever the data.
SHARD_UNITS = 86_400_000

#: Rows a task gathers before it unites them.
GATHERED = 500_000


def unite(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of the union of bit ranges lo..hi, per group: (group, lo, hi), sorted.

    The furthest end so far is found over ranks of the ends, not the ends themselves,
    so no value of the data can overflow into another group.
    """
    if not len(group):
        return group, lo, hi
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    opens = np.concatenate(([True], group[1:] != group[:-1]))
    ends, rank = np.unique(hi, return_inverse=True)
    base = (np.cumsum(opens) - 1) * len(ends)  # below the square of the rows
    reach = ends[np.maximum.accumulate(rank + base) - base]
    begins = opens
    begins[1:] |= (lo[1:] > reach[:-1]) & (lo[1:] - 1 > reach[:-1])
    at = np.flatnonzero(begins)
    return group[at], lo[at], reach[np.append(at[1:], len(lo)) - 1]


def _group_codes(names: pa.Array, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense code per (entity, shard) and one row of each code."""
    encoded = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    present, place = np.unique(shards, return_inverse=True)
    _, rows, codes = np.unique(encoded * max(len(present), 1) + place, return_index=True, return_inverse=True)
    return codes, rows


_COLUMNS = ("entity", "shard", "upto", "n", "first_lo", "first_hi", "last_lo", "last_hi", "runs")


def _batch(names: pa.Array, shards: np.ndarray, upto: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One row per group with its runs as (start, length - 1) pairs, its first run and its last."""
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    stop = np.append(at[1:], len(lo)) if len(at) else at
    flat = np.empty(2 * len(lo), np.int64)
    flat[0::2], flat[1::2] = lo, hi - lo
    offsets = pa.array(np.append(at, len(lo)) * 2, pa.int32())
    numbers = [shards[group[at]], upto[group[at]], stop - at, lo[at], hi[at], lo[stop - 1], hi[stop - 1]]
    return pa.RecordBatch.from_arrays([names.take(pa.array(group[at])), *[pa.array(x, pa.int64()) for x in numbers], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], names=list(_COLUMNS))


def run_bitmaps(intervals: DataFrame, width: int) -> DataFrame:
    """Runs of set bits from (entity, s, e), one row per entity and shard of ``width`` units.

    Gives (entity, shard, ``upto``, ``n``, ``first_lo``, ``first_hi``, ``last_lo``, ``last_hi``, ``runs``); bits count from the
    shard's begin, two a unit. ``upto`` is beyond ``shard`` where the shards from it to
    ``upto`` are set as a whole; other rows may lie inside such a span.
    """
    ship(intervals.sparkSession)
    kind = intervals.schema["entity"].dataType.simpleString()
    schema = f"entity {kind}, shard long, upto long, n long, first_lo long, first_hi long, last_lo long, last_hi long, runs array<long>"
    top = 2 * width - 1

    def united(names: pa.Array, shards: np.ndarray, upto: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        """Rows of (entity, shard, upto) whose runs are lo..hi; ``row`` says whose a run is."""
        codes, rows = _group_codes(names, shards)
        furthest = np.full(len(rows), np.iinfo(np.int64).min)
        np.maximum.at(furthest, codes, upto)
        whole = (upto > shards)[row]
        group, low, high = unite(codes[row], np.where(whole, 0, lo), np.where(whole, top, hi))
        return _batch(names.take(pa.array(rows)), shards[rows], furthest, group, low, high)

    def cut(whole: pa.Table) -> pa.RecordBatch:
        names, s, e = whole.column(0).combine_chunks(), whole.column(1).to_numpy(), whole.column(2).to_numpy()
        first, last, low, high = s // width, e // width, 2 * (s % width), 2 * (e % width)
        own, ends = np.arange(len(s)), np.flatnonzero(last > first)
        # Shards between the first and the last, which an interval sets as a whole: one row.
        between = np.flatnonzero((last > first) & (last - 1 > first))
        codes, rows = _group_codes(names.take(pa.array(between)), np.zeros(len(between), np.int64))
        spanned, a, b = unite(codes, first[between] + 1, last[between] - 1)
        row = np.concatenate((own, ends, between[rows[spanned]]))
        shard, upto = np.concatenate((first, last[ends], a)), np.concatenate((first, last[ends], b))
        lo = np.concatenate((low, np.zeros(len(ends) + len(a), np.int64)))
        hi = np.concatenate((np.where(last > first, top, high), high[ends], np.full(len(a), top)))
        return united(names.take(pa.array(row)), shard, upto, np.arange(len(row)), lo, hi)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHERED:
                yield cut(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield cut(pa.Table.from_batches(held))

    def join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        runs = whole.column(8).combine_chunks()
        flat = runs.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(whole.num_rows), np.diff(runs.offsets.to_numpy()) // 2)
        return united(whole.column(0).combine_chunks(), whole.column(1).to_numpy(), whole.column(2).to_numpy(), row, flat[0::2], flat[0::2] + flat[1::2])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by entity and shard. The last group, united so far, waits for the next batch."""
        held: list[pa.RecordBatch] = []
        size, most = 0, GATHERED
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows + len(batch.column(8).flatten())
            if size >= most:
                # Codes aren't in the rows' order, so the last group is found by its key.
                entity, shard = batch.column(0)[-1], batch.column(1)[-1].as_py()
                done = join(held)
                names = done.column(0)
                last = next(i for i in np.flatnonzero(done.column(1).to_numpy() == shard).tolist() if names[i] == entity)
                yield done.filter(pa.array(np.arange(done.num_rows) != last))
                held = [done.slice(last, 1)]
                size = 1 + len(held[0].column(8).flatten())
                most = max(GATHERED, 2 * size)  # so a large group isn't united again for each batch
        if held:
            yield join(held)

    partial = intervals.select("entity", "s", "e").mapInArrow(pieces, schema)
    return partial.repartition("entity", "shard").sortWithinPartitions("entity", "shard").mapInArrow(merge, schema)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, shard_units: int = SHARD_UNITS) -> DataFrame:
    """(entity, ``kind`` `period` or `gap`, ``from_unit`` long, ``to_unit`` long) of closed integer intervals.

    Intervals that share at least one instant, end points included, form one
    period; a gap runs from a period's end to the next period's start. Rows with a
    null entity, start or end, or an end before the start, don't count; repeated
    rows change nothing; an empty table gives no rows. Any 64-bit times will do. Shards are
    ``shard_units`` wide whatever the data, and an interval makes three rows of runs at most,
    however long it is. Only the three named columns are read.
    """
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("entity is not null and s <= e")
    shards = materialize(run_bitmaps(rows, shard_units), "interval-runs")

    def instant(bit: Column, shard: str = "shard") -> Column:
        """The time of a shard's bit; the shard's begin may lie below the least number."""
        shard, unit = F.col(shard), F.shiftright(bit, 1)
        return F.when(shard < 0, (shard + 1) * shard_units + (unit - shard_units)).otherwise(shard * shard_units + unit)

    # A shard inside a span that began earlier adds nothing; a span goes on where an earlier one ends.
    by_shard = Window.partitionBy("entity").orderBy("shard")  # as many rows as shards, without their runs
    edges = shards.select("entity", "shard", "upto", "n", "first_lo", "first_hi", "last_lo", "last_hi")
    edges = edges.withColumn("reach", F.max("upto").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)))
    covered = edges.where("upto <= reach").select("entity", "shard")
    edges = edges.where("reach is null or upto > reach").withColumn("shard", F.when(F.col("shard") <= F.col("reach"), F.col("reach") + 1).otherwise(F.col("shard")))

    # Runs at shard borders go on if they touch. chain is where the period of a shard's last run begins.
    edges = edges.withColumns({"begin": instant(F.col("first_lo")), "first_end": instant(F.col("first_hi")), "opened": instant(F.col("last_lo")), "end": instant(F.col("last_hi"), "upto")})
    touches = (F.try_add(F.lag("upto").over(by_shard), F.lit(1)) == F.col("shard")) & (F.lag("last_hi").over(by_shard) == 2 * shard_units - 1) & (F.col("first_lo") == 0)
    edges = edges.withColumns({"before": F.lag("end").over(by_shard), "joined": F.coalesce(touches, F.lit(False))})
    upto = by_shard.rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumns({"chain": F.last(F.when((F.col("n") > 1) | ~F.col("joined"), F.col("opened")), ignorenulls=True).over(upto), "goes_on": F.coalesce(F.lead("joined").over(by_shard), F.lit(False))})
    edges = edges.withColumn("chain_before", F.lag("chain").over(by_shard))

    def item(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("from_unit"), b.alias("to_unit"))

    several = F.col("n") > 1
    opening = F.when(several, item("period", F.when(F.col("joined"), F.col("chain_before")).otherwise(F.col("begin")), F.col("first_end")))
    closing = F.when(~F.col("goes_on"), item("period", F.col("chain"), F.col("end")))
    across = F.when(F.col("before").isNotNull() & ~F.col("joined"), item("gap", F.col("before"), F.col("begin")))
    borders = edges.select("entity", F.explode(F.array_compact(F.array(opening, closing, across))).alias("x")).select("entity", "x.*")

    # Within a shard: the runs between its first and last are periods, the clear runs are gaps.
    inside = shards.where("n > 1").select("entity", "shard", "n", "runs").join(covered, ["entity", "shard"], "left_anti")
    start_of = lambda i: F.element_at("runs", (2 * i - 1).cast("int"))  # noqa: E731 - i counts from 1
    run_lo, run_hi = lambda i: instant(start_of(i)), lambda i: instant(start_of(i) + F.element_at("runs", (2 * i).cast("int")))
    set_runs = F.when(F.col("n") > 2, F.transform(F.sequence(F.lit(2).cast("long"), F.col("n") - 1), lambda i: item("period", run_lo(i), run_hi(i)))).otherwise(F.array().cast("array<struct<kind:string,from_unit:bigint,to_unit:bigint>>"))
    clear_runs = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n") - 1), lambda i: item("gap", run_hi(i), run_lo(i + 1)))
    within = inside.select("entity", F.explode(F.concat(set_runs, clear_runs)).alias("x")).select("entity", "x.*")
    return borders.unionByName(within).select(F.col("entity").alias(entity), "kind", "from_unit", "to_unit")
