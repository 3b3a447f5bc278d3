"""One row per entity from events: count, last time and total size per event type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.operators.skew import salted_aggregate, weighed_keys
from loomflow.runtime import materialize

#: More event types than this are no feature columns.
MOST_TYPES = 10_000

#: Types as written whose names are broadcast; more are joined by shuffle.
MOST_SPELLINGS = 100_000

#: Cells of dense arrays that a task makes at once.
CELLS = 1_000_000


def epoch_ms(value: Column) -> Column:
    """Epoch seconds, milli-, micro- or nanoseconds as milliseconds, finer parts cut off.

    The unit shows in the size: 1e11 seconds are the year 5138, 1e11 milliseconds
    1973, and so on by factors of a thousand. Null and not positive values give null.
    """
    v = value.cast("long")
    return (
        F.when(v <= 0, None)
        .when(v < 100_000_000_000, v * 1000)
        .when(v < 100_000_000_000_000, v)
        .when(v < 100_000_000_000_000_000, F.floor(v / F.lit(1000).cast("decimal(4,0)")).cast("long"))
        .otherwise(F.floor(v / F.lit(1_000_000).cast("decimal(7,0)")).cast("long"))
    )


def upper_words(text: Column) -> Column:
    """The words of letters and digits in upper case, joined by ``_``; null for none."""
    joined = F.regexp_replace(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")
    return F.when(joined != "", joined)


def event_statistics(df: DataFrame, entity: Column, kind: Column, event: Column, time: Column, size: Column, salts: int | None = None) -> DataFrame:
    """(entity, eventtype, ``n_events``, ``last_ms``, ``total_size``) over distinct events.

    Entities are compared in lower case without outer white space; types by letters
    and digits only and put out as UPPER_CASE words, in the spelling of most words
    that the data has for a type. Events without entity, type, id or positive time
    don't count; copies of one event count once, with its latest time and largest
    size; null sizes add 0. An empty table gives no rows.

    Spellings are settled on the column of types alone, hot groups found on the two key columns, so
    the events themselves pass in one go: copies meet first (entity, type, id spread any hot
    type), then two salted stages sum up: entity-type groups that hold much of the data are
    spread over salts.
    """
    rows = df.select(
        F.lower(F.regexp_replace(entity.cast("string"), r"^\s+|\s+$", "")).alias("entity"),
        kind.cast("string").alias("raw"),
        event.alias("event"),
        epoch_ms(time).alias("ms"),
        size.cast("long").alias("size"),
    )
    spellings = _spellings(rows.select("raw"))
    few = spellings.count() <= MOST_SPELLINGS
    named = rows.join(F.broadcast(spellings) if few else spellings, "raw").where("entity is not null and entity <> '' and event is not null and ms is not null")
    heavy = materialize(weighed_keys(named.select("entity", "words"), ["entity", "words"]), "feature-heavy")
    merged = salted_aggregate(
        named.groupBy("entity", "words", "event").agg(F.max("ms").alias("ms"), F.max("size").alias("size")),
        ["entity", "words"],
        {"n_events": F.count(F.lit(1)), "last_ms": F.max("ms"), "total_size": F.sum(F.coalesce("size", F.lit(0)))},
        {"n_events": F.sum, "last_ms": F.max, "total_size": F.sum},
        salt_by=["event"],
        salts=salts,
        heavy=heavy,
    )
    return merged.withColumnRenamed("words", "eventtype")


def _spellings(types: DataFrame) -> DataFrame:
    """(raw, words) of each type as written: its name, in the spelling of most words where
    types differ only in where words end. Types without letters and digits are left out."""
    spelt = types.where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    spelt = spelt.withColumn("words", upper_words(F.col("raw"))).where("words is not null").withColumn("squashed", F.replace("words", F.lit("_"), F.lit("")))
    spelt = materialize(spelt, "feature-spellings")
    of_words = spelt.groupBy("squashed", "words").agg(F.sum("n").alias("n"))
    best = of_words.groupBy("squashed").agg(F.max_by("words", F.struct(F.length("words"), "n", "words")).alias("best"))
    return materialize(spelt.join(best, "squashed").select("raw", F.col("best").alias("words")), "feature-names")


def feature_table(statistics: DataFrame, prefix: str = "") -> DataFrame:
    """One row per entity, expanded to the complete type list: ``types``, ``counts``,
    ``last_ms`` and ``sizes`` are arrays of equal order in every row, the types sorted.

    A type an entity lacks has count 0, size 0 and a null last time; ``n_events`` and
    ``latest_ms`` are over all types. The type list is read to the driver, at most
    MOST_TYPES names, more raise an error. An empty table gives no rows.
    """
    statistics = materialize(statistics, "feature-statistics")
    types = [r[0] for r in statistics.select("eventtype").distinct().limit(MOST_TYPES + 1).collect()]
    if len(types) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types")
    listed = pa.array(sorted(types) or [""], pa.string())  # no types: no rows either
    cell = F.struct("eventtype", "n_events", "last_ms", "total_size")
    per = statistics.groupBy("entity").agg(F.sum("n_events").alias("n_events"), F.max("last_ms").alias("latest_ms"), F.collect_list(cell).alias("cells"))
    kind = statistics.schema["entity"].dataType.simpleString()
    names = ["entity", *[prefix + n for n in ("n_events", "latest_ms", "types", "counts", "last_ms", "sizes")]]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scatters the cells of a batch of entities into dense arrays over all types."""
        width = len(listed)
        rows = max(1, CELLS // width)
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            lists = batch.column(3)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            place = row * width + pc.index_in(flat.field("eventtype"), value_set=listed).to_numpy()
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            dense = []
            for field, missing in (("n_events", False), ("last_ms", True), ("total_size", False)):
                values, absent = np.zeros(batch.num_rows * width, np.int64), np.full(batch.num_rows * width, missing)
                values[place], absent[place] = flat.field(field).to_numpy(), False
                dense.append(pa.ListArray.from_arrays(ends, pa.array(values, mask=absent)))
            every = pa.ListArray.from_arrays(ends, pa.concat_arrays([listed] * batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], every, *dense], names=names)

    schema = f"entity {kind}, {names[1]} long, {names[2]} long, {names[3]} array<string>, {names[4]} array<long>, {names[5]} array<long>, {names[6]} array<long>"
    return per.mapInArrow(expand, schema)
