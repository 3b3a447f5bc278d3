"""Hooks for user code, all in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf, udtf


def processor(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user's task: sees its partition as a stream of batches, gives a stream of batches."""
    return df.mapInPandas(run, schema)


def group_aggregate(function: Callable[[pd.Series], object], kind: str) -> Callable:
    """A user-defined aggregate over a column; each group must fit in a task."""

    def whole(values: pd.Series):  # noqa: ANN202 - annotated below
        return function(values)

    whole.__annotations__ = {"values": pd.Series, "return": float if kind in ("double", "float") else int if kind in ("long", "int") else str}
    return pandas_udf(whole, kind)


@udtf(returnType="word: string")
class SplitWords:
    """Table function: the words of a text."""

    def eval(self, text: str) -> Iterator[tuple[str]]:
        for word in (text or "").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" "):
            if word:
                yield (word,)
