"""Shared window specs. Every per-series operator orders by ``ssd`` inside
``partitionBy(keys)`` with the same spec, so consecutive window operators
share one exchange and one sort."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, Window, WindowSpec


def series_window(keys: Iterable[str] = (), order: str = "ssd") -> WindowSpec:
    keys = list(keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(order)


def trailing(keys: Iterable[str], n: int, order: str = "ssd") -> WindowSpec:
    """Frame of the current row and the ``n - 1`` rows before it."""
    return series_window(keys, order).rowsBetween(-(n - 1), Window.currentRow)


def merged(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df`` as the right side of a join by series: merged with rows that are dealt
    the same way, never broadcast. The planner takes a side for as small as the file
    it comes from, whatever it is widened or exploded to since."""
    return df.hint("merge") if list(keys) else df


def beside(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df``, a few rows per series (parameters, models, means), as the right side of
    a join by series: each task hashes those of its series, and the rows they are
    joined to need no sort and keep their order. Never broadcast."""
    return df.hint("shuffle_hash") if list(keys) else df
