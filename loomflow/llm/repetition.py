"""Share of each document that repeats within it.

Each document is hashed by itself: words become 64-bit codes, rolling hashes of
several n-gram lengths find n-grams that occur again, and the words and
characters they cover are measured, as are repeated lines and paragraphs. The
work is one map over the corpus: no shuffle, no skew, whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.llm.words import words
from loomflow.runtime import ship

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Spread small word codes over 64 bits, so that sums of them rarely collide."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered_words(mixed: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which words lie in an n-gram that occurs at least ``least`` times (overlaps count)."""
    total = len(mixed)
    if total < n:
        return np.zeros(total, bool)
    grams = np.zeros(total - n + 1, np.uint64)
    for j in range(n):  # Horner's rule over all positions at once
        grams = grams * _BASE + mixed[j : total - n + 1 + j]
    order = np.argsort(grams, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], grams[order][1:] != grams[order][:-1])))
    sizes = np.diff(np.append(starts, len(grams)))
    often = np.empty(len(grams), bool)
    often[order] = np.repeat(sizes >= least, sizes)
    steps = np.zeros(total + 1, np.int64)
    steps[:-n] += often
    steps[n:] -= often
    return np.cumsum(steps[:-1]) > 0


def _repeated_chars(parts: list[str]) -> int:
    """Characters of parts (lines, paragraphs) that occur more than once, all copies counted."""
    trimmed = [p for p in (x.strip() for x in parts) if p]
    counts = Counter(trimmed)
    return sum(len(p) for p in trimmed if counts[p] > 1)


_SIMPLE = (("n_words", T.LongType()), ("n_chars", T.LongType()), ("line_share", T.DoubleType()), ("paragraph_share", T.DoubleType()))


def repetition(df: DataFrame, ident: str, text: str, grams: Sequence[tuple[int, int]] = ((2, 2), (4, 2), (6, 3), (10, 2)), lines: bool = True) -> DataFrame:
    """One row per row of ``df``: the identifier, ``n_words``, ``n_chars``, and for each
    (n, least) of ``grams`` the words (``words_n_least``) and the share of characters
    (``chars_n_least``) inside n-grams of words that occur ``least`` times or more;
    with ``lines`` the share of characters in repeated lines and paragraphs.

    A null or empty text has 0 words and characters and shares of 0. Repeated ids
    give repeated rows. Only the two named columns are read. Words and hashes are of
    the whole text, whatever its length.
    """
    ship(df.sparkSession)
    fields = [T.StructField("__id", df.schema[ident].dataType)] + [T.StructField(n, t) for n, t in _SIMPLE]
    for n, least in grams:
        fields += [T.StructField(f"words_{n}_{least}", T.LongType()), T.StructField(f"chars_{n}_{least}", T.DoubleType())]
    schema = T.StructType(fields)
    grams = tuple(grams)

    def profile(value: str | None) -> list:
        value = value or ""
        found = words(value)
        seen: dict[str, int] = {}
        codes = np.array([seen.setdefault(w, len(seen)) for w in found], np.int64)
        lengths = np.array(list(map(len, found)), np.int64)
        mixed, chars = _mixed(codes), int(lengths.sum())
        row: list = [len(found), len(value), 0.0, 0.0]
        if lines and value:
            row[2] = _repeated_chars(value.split("\n")) / len(value)
            row[3] = _repeated_chars(re.split(r"\n\s*\n", value)) / len(value)
        for n, least in grams:
            inside = covered_words(mixed, n, least)
            row += [int(inside.sum()), float(lengths[inside].sum()) / chars if chars else 0.0]
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = [profile(t.as_py()) for t in batch.column(1)]
                columns = [batch.column(0).cast(arrow.field(0).type)]
                columns += [pa.array([r[i] for r in rows], type=arrow.field(i + 1).type) for i in range(len(arrow) - 1)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = df.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
    kept = [c for c in schema.names[1:] if lines or c not in ("line_share", "paragraph_share")]
    return found.select(F.col("__id").alias(ident), *kept)
