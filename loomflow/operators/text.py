"""Line and word operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space, tab, line feed, carriage return and form feed separate words; nothing else does.
TOKEN_DELIMITERS = "[ \t\n\r\f]+"


def tokens(text: Column) -> Column:
    """array<string> of the words of a text, case and punctuation kept, no empty ones; null for null."""
    return F.filter(F.split(text, TOKEN_DELIMITERS), lambda w: w != "")


def tokenize(df: DataFrame, text: str, keep: Sequence[str] = (), word: str = "word") -> DataFrame:
    """Flat map of a text column to its words. Null and blank texts give no rows."""
    return df.select(*keep, F.explode(tokens(F.col(text))).alias(word))


def word_count(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., word, cnt): one shuffle of map-side combined counts; cnt is a bigint."""
    return tokenize(df, text, keys).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"))


def ordered_word_count(df: DataFrame, text: str) -> DataFrame:
    """Word counts in global ascending order of count, ties by word: a range sort, not one task."""
    return word_count(df, text).orderBy("cnt", "word")


def lines_of(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., line_no from 1, line): texts split at line feeds; null texts give no rows."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def filter_lines(df: DataFrame, text: str, word: str, keep: Sequence[str] = ()) -> DataFrame:
    """Lines that contain ``word`` as a substring, with their number: a narrow map."""
    rows = df.where(F.col(text).contains(word))
    return lines_of(rows, text, keep).where(F.col("line").contains(word))


def filter_lines_to_one_writer(df: DataFrame, text: str, word: str, keep: Sequence[str] = ()) -> DataFrame:
    """``filter_lines`` gathered for one writer: tasks filter side by side, only matching lines move."""
    return filter_lines(df, text, word, keep).repartition(1)
