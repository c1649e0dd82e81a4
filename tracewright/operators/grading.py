"""Grading of many answers by their different pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graded_by(df: DataFrame, columns: list[str], grade: Callable[..., Column], name: str = "verdict") -> DataFrame:
    """df with grade(*columns) as column name, computed once for each different tuple of columns (nulls equal nulls).

    Samples of one question repeat a few answers, and grading costs far more than the
    exchange of the tuples, which are reduced before it. A tuple that a third of the rows
    have is split by the skew handling of adaptive joins.
    """
    different = df.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)]).distinct()
    verdicts = different.select("*", grade(*[F.col(f"_{k}") for k in range(len(columns))]).alias(name))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(columns)])
    return df.join(verdicts, on).select(*[F.col(c) for c in df.columns], name)


def graded(df: DataFrame, given: str, gold: str, grade: Callable[[Column, Column], Column], name: str = "verdict") -> DataFrame:
    """graded_by the pair of an answer and its gold answer."""
    return graded_by(df, [given, gold], grade, name)
