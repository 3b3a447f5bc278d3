"""Top N rows of every group by simultaneous per-group bisection.

No group is ever sorted. All groups refine a cutoff at once on a code that orders
rows by score, then identifier: each pass counts, with map-side combining, the
rows above many midpoints of each group's open interval, keeps rows above the
cutoff, drops those below, and goes on with the rest until each group holds
exactly N.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomflow.operators.skew import hot_join
from loomflow.runtime import materialize

#: Midpoints per group and pass, as a power of two: one pass does so many bisection steps.
STEPS = 6


def _coarse(score: Column) -> Column:
    """The first pass's cut points, the same for all groups: 64 per doubling of the
    score, monotone for either sign, so a group has at most some thousands."""
    size = F.least(F.log2(F.abs(score.cast("double")) + 1), F.lit(1100.0))  # infinity comes last
    return (F.signum(score) * F.floor(size * 64)).cast("int")


def _code(ident: Column, start: Column) -> Column:
    """Seven bytes of a text from byte ``start`` (1-based) on as an order-preserving
    number; a text that ends earlier comes before its extensions."""
    digits = F.hex(F.substring(F.encode(ident, "UTF-8"), start, F.lit(7)))
    shifted = F.rpad(F.translate(digits, "0123456789ABCDEF", "123456789ABCDEFG"), 14, "0")
    return F.conv(shifted, 17, 10).cast("long")


def _common_bytes(a: Column, b: Column) -> Column:
    """Length in bytes of the common start of two texts."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    length = (F.least(F.length(x), F.length(y)) / 2).cast("int")
    # bisection over the prefix length, so long identifiers cost few steps
    found = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)),
        F.struct(F.lit(0).alias("lo"), length.alias("hi")),
        lambda acc, _: F.struct(
            F.when(F.substring(x, F.lit(1), 2 * F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")) == F.substring(y, F.lit(1), 2 * F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")), F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")).otherwise(acc["lo"]).alias("lo"),
            F.when(F.substring(x, F.lit(1), 2 * F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")) == F.substring(y, F.lit(1), 2 * F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")), acc["hi"]).otherwise(F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int") - 1).alias("hi"),
        ),
    )
    return found["lo"]


def _cutoffs(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Of each group the midpoint interval in which its need-th row from the top lies.

    ``counts``: names, ``__b`` (interval), ``__c`` (rows in it), ``__need``. Gives
    names, ``__cut``, ``__above``, ``__inside``, ``__rows``, ``__need``.
    """
    from_top = Window.partitionBy(*names).orderBy(F.col("__b").desc())
    whole = Window.partitionBy(*names)
    ranked = counts.withColumn("__upto", F.sum("__c").over(from_top)).withColumn("__rows", F.sum("__c").over(whole))
    above = F.col("__upto") - F.col("__c")
    reached = ranked.where((above < F.col("__need")) & ((F.col("__upto") >= F.col("__need")) | (F.col("__upto") == F.col("__rows"))))
    return reached.select(*names, F.col("__b").alias("__cut"), above.alias("__above"), F.col("__c").alias("__inside"), "__rows", "__need")


def top_n_per_group(df: DataFrame, keys: Sequence[str], score: str, ident: str, n: int, max_passes: int = 500) -> DataFrame:
    """The ``n`` items of the highest score of every group, ties by identifier upwards
    (binary order of its UTF-8 text): (keys..., ``rank_no`` int, score, identifier).

    Rows that repeat an identifier within a group are one item, of its highest
    score. Null and NaN scores don't rank; null keys form a group of their own; a
    null identifier is an item that comes last among ties. Groups with fewer than
    ``n`` items give all of them; an empty table gives no rows. Other columns of
    ``df`` aren't read and may have any names.
    """
    if n < 1:
        raise ValueError("n must be positive")
    names = [f"__k{i}" for i in range(len(keys))]
    kind = df.schema[score].dataType
    wide = "long" if isinstance(kind, T.IntegralType) else "double"
    rows = df.select(
        *[F.col(k).alias(c) for k, c in zip(keys, names)],
        F.col(score).cast(wide).alias("__s"),
        F.when(F.col(ident).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(ident).cast("string"))).alias("__i"),
    )
    rows = rows.where(F.col("__s").isNotNull() & ~F.isnan(F.col("__s").cast("double")))
    items = materialize(rows.groupBy(*names, "__i").agg(F.max("__s").alias("__s")), "topn-items")

    need = F.lit(n).cast("long").alias("__need")
    counts = items.groupBy(*names, _coarse(F.col("__s")).alias("__b")).agg(F.count(F.lit(1)).alias("__c")).withColumn("__need", need)
    cutoffs = materialize(_cutoffs(counts, names), "topn-cutoffs")
    flag = F.when(F.col("__b") > F.col("__cut"), 1).when(F.col("__above") + F.col("__inside") <= F.col("__need"), 1).otherwise(0)
    near = hot_join(items.withColumn("__b", _coarse(F.col("__s"))), cutoffs, names, "__rows").where("__b >= __cut")
    near = near.select(*names, "__s", "__i", flag.alias("__in"), (F.col("__need") - F.col("__above")).alias("__need"))
    step = materialize(near, "topn-near")
    winners = [step.where("__in = 1").select(*names, "__s", "__i")]
    open_rows = step.where("__in = 0").select(*names, "__s", "__i", "__need")

    for _ in range(max_passes):
        if open_rows.isEmpty():
            break
        step = _refine(open_rows, names, wide)
        winners.append(step.where("__in = 1").select(*names, "__s", "__i"))
        open_rows = step.where("__in = 0").select(*names, "__s", "__i", "__need")
    else:
        raise RuntimeError(f"cutoffs not found within {max_passes} passes")

    held = winners[0]
    for more in winners[1:]:
        held = held.unionByName(more)
    order = Window.partitionBy(*names).orderBy(F.col("__s").desc(), F.col("__i"))  # n rows a group
    text = F.when(F.col("__i") != "1", F.expr("substring(__i, 2)")).cast(df.schema[ident].dataType)
    ranked = held.withColumn("__r", F.row_number().over(order))
    return ranked.select(*[F.col(c).alias(k) for k, c in zip(keys, names)], F.col("__r").alias("rank_no"), F.col("__s").cast(kind).alias(score), text.alias(ident))


def _refine(open_rows: DataFrame, names: Sequence[str], wide: str) -> DataFrame:
    """One pass over the undecided groups: on the score while it varies, then on the
    identifier behind its common start."""
    spans = open_rows.groupBy(*names).agg(
        F.min("__s").alias("__lo"), F.max("__s").alias("__hi"), F.min("__i").alias("__il"), F.max("__i").alias("__ih"), F.count(F.lit(1)).alias("__rows")
    )
    spans = spans.withColumn("__at", F.when(F.col("__lo") == F.col("__hi"), _common_bytes(F.col("__il"), F.col("__ih")) + 1))
    spans = spans.withColumn("__cl", _code(F.col("__il"), F.col("__at"))).withColumn("__ch", _code(F.col("__ih"), F.col("__at")))
    spans = spans.select(*names, "__lo", "__hi", "__at", "__cl", "__ch", "__rows")
    parts = 1 << STEPS

    def interval(x: Column, lo: Column, hi: Column) -> Column:
        # halves before subtracting: the span of two longs may not fit in a long
        place = F.floor(F.nanvl(F.coalesce(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0)), F.lit(0.0)) * parts)
        return F.when(x >= hi, parts).when(x <= lo, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), place))).cast("int")

    by_score = interval(F.col("__s").cast("double"), F.col("__lo").cast("double"), F.col("__hi").cast("double"))
    exact = F.when(F.col("__s") == F.col("__hi"), parts).when(F.col("__s") == F.col("__lo"), -1).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), by_score)))
    code = _code(F.col("__i"), F.col("__at"))
    by_ident = interval(-code.cast("double"), -F.col("__ch").cast("double"), -F.col("__cl").cast("double"))
    by_ident = F.when(code == F.col("__cl"), parts).when(code == F.col("__ch"), -1).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), by_ident)))
    placed = hot_join(open_rows, spans, names, "__rows").withColumn("__b", F.when(F.col("__lo") == F.col("__hi"), by_ident).otherwise(exact).cast("int"))
    placed = materialize(placed.select(*names, "__s", "__i", "__need", "__b"), "topn-open")
    counts = placed.groupBy(*names, "__b").agg(F.count(F.lit(1)).alias("__c"), F.max("__need").alias("__need"))
    cutoffs = materialize(_cutoffs(counts, names).withColumnRenamed("__need", "__want"), "topn-cutoffs")
    kept = hot_join(placed, cutoffs, names, "__rows").where("__b >= __cut")
    flag = F.when(F.col("__b") > F.col("__cut"), 1).when(F.col("__above") + F.col("__inside") <= F.col("__want"), 1).otherwise(0)
    return materialize(kept.select(*names, "__s", "__i", flag.alias("__in"), (F.col("__want") - F.col("__above")).alias("__need")), "topn-near")
