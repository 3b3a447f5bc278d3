"""Per-key results for several key fields of which a few keys hold most rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.operators.skew import salted_aggregate
from loomflow.runtime import materialize


def key_results(
    df: DataFrame,
    fields: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    salt_by: Sequence[str],
    salts: int | None = None,
    distinct: dict[str, str] | None = None,
    else_by: Sequence[str] = (),
) -> DataFrame:
    """(``key_field``, ``key_value`` string, the aggregates, ``n_rows``, ``row_share``) for every
    value of every field, in two salted stages over one reading of the table.

    ``n_rows`` counts every row, repeated ones too, and ``row_share`` is its share of all
    rows of the table. A null value is a key of its own, so that shares of a field
    add up to 1. ``partial`` sees the columns in ``salt_by``, ``else_by`` and those it names; see
    ``salted_aggregate``. ``distinct`` names a column to count the distinct values of, per
    name: its values meet once, with the keys each occurs with, whatever the number of fields. An
    empty table gives no rows.
    """
    def keyed(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields])
        return rows.select(*kept, F.explode(pairs).alias("__pair")).select(F.col("__pair.key_field").alias("__field"), F.col("__pair.key_value").alias("__value"), *kept)

    keys = ["__field", "__value"]
    read = [c for c in df.columns if c in {*salt_by, *else_by} or any(_mentions(x, c) for x in partial.values())]
    found = salted_aggregate(keyed(df, read), keys, {"__rows": F.count(F.lit(1)), **partial}, {"__rows": F.sum, **merge}, salt_by, salts, else_by=else_by)
    for name, column in (distinct or {}).items():
        found = found.join(_distinct(df, fields, column, name), (F.col("__field") == F.col("__f")) & F.col("__value").eqNullSafe(F.col("__v")), "left").drop("__f", "__v")
        found = found.withColumn(name, F.coalesce(name, F.lit(0)))
    found = materialize(found, "key-results")  # a row per key; the shares need its total
    totals = found.where(F.col("__field") == fields[0]).agg(F.sum("__rows")).scalar()
    return found.select(
        F.col("__field").alias("key_field"), F.col("__value").alias("key_value"), *[c for c in found.columns if not c.startswith("__")], F.col("__rows").alias("n_rows"), (F.col("__rows") / totals).alias("row_share")
    )


def _mentions(expression: Column, column: str) -> bool:
    """Whether an expression names the column, or may: long ones are printed cut."""
    written = str(expression)
    return "..." in written or re.search(rf"(?<![\w.]){re.escape(column)}(?![\w.])", written) is not None


def _distinct(df: DataFrame, fields: Sequence[str], column: str, name: str) -> DataFrame:
    """(``__f``, ``__v``, ``name``): how many distinct values of the column each key has. A value's sets hold keys, not rows."""
    def set_of(field: str) -> Column:
        return F.collect_set(F.coalesce(F.concat(F.lit("="), F.col(field).cast("string")), F.lit("")))  # null is a key too

    def keys_of(field: str, values: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("__f"), v.alias("__v")))

    sets = df.where(F.col(column).isNotNull()).groupBy(column).agg(*[set_of(f).alias(f"__s{i}") for i, f in enumerate(fields)])
    listed = F.concat(*[keys_of(f, f"__s{i}") for i, f in enumerate(fields)])
    rows = sets.select(F.inline(listed)).groupBy("__f", "__v").agg(F.count(F.lit(1)).alias(name))
    return rows.select("__f", F.when(F.col("__v") != "", F.expr("substring(__v, 2)")).alias("__v"), name)
