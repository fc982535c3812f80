"""Evaluate a costly expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column which later filters and projections cannot unfold again.

    The optimizer copies an expression into every place that uses the column,
    so a parsed document would be parsed once per used field.  A generator is
    a boundary for that; an array of one value gives one row per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, within one expression.

    For values a lambda uses several times or for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
