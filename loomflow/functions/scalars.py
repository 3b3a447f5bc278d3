"""Scalar expressions that dataflows and analyzers share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, finer parts cut off."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000).cast("decimal(4,0)")).cast("long")


def detailed_status(status: Column, cause: Column) -> Column:
    """``status:cause``, or the status alone without a cause."""
    return F.when(cause.isNull() | (cause == ""), status).otherwise(F.concat(status, F.lit(":"), cause))


def one_line(text: Column) -> Column:
    """Commas and line feeds as spaces, for rows of comma-separated output."""
    return F.regexp_replace(text, "[,\n]", " ")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """Half up in binary arithmetic, which any engine repeats; ``round`` of doubles differs among engines at ties."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null where the whole is 0 or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def post_data_ms(start: Column, finish: Column, last_data: Column) -> Column:
    """Time from the later of start and last data to the finish; -1 without a start or finish."""
    return F.when((start <= 0) | (finish <= 0) | start.isNull() | finish.isNull(), -1).otherwise(finish - F.greatest(start, F.coalesce(last_data, start)))


def locality_class(data_local: Column, rack_local: Column, other_local: Column) -> Column:
    """The first counter present of data, rack and other."""
    return F.when(data_local.isNotNull(), "DATA_LOCAL").when(rack_local.isNotNull(), "RACK_LOCAL").when(other_local.isNotNull(), "OTHER_LOCAL")
