"""Casts at the scan boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest leading numeric prefix, after optional leading blanks: sign, digits
# with optional fraction (or a bare fraction) and an optional exponent.
_NUMERIC_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_real(c, mode: str = "prefix") -> Column:
    """Text → DOUBLE.

    ``prefix``: never fails; the longest numeric prefix, else 0.0, NULL stays
    NULL (the lenient cast of an embedded SQL store: ``'1,234.5'`` → 1.0,
    ``'abc'`` → 0.0).  ``strict``: ``try_cast``; anything malformed → NULL.
    NaN is always turned into NULL so averages and sorts behave.
    """
    c = _as_col(c)
    if mode == "strict":
        out = c.try_cast(T.DoubleType())
    elif mode == "prefix":
        prefix = F.nullif(F.regexp_extract(c.cast("string"), _NUMERIC_PREFIX, 1), F.lit(""))
        out = F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
            F.coalesce(prefix.try_cast(T.DoubleType()), F.lit(0.0)))
    else:
        raise ValueError(f"unknown cast mode {mode!r}")
    return nan_to_null(out)


def is_bad_real(c, mode: str = "prefix") -> Column:
    """A text that is there but holds no number: no numeric prefix (``prefix``) or
    not a number as a whole (``strict``)."""
    c = _as_col(c)
    good = c.try_cast(T.DoubleType()).isNotNull() if mode == "strict" else c.cast("string").rlike(_NUMERIC_PREFIX)
    return c.isNotNull() & ~good


def nan_to_null(c) -> Column:
    """NaN → NULL (Spark sorts NaN as largest and ``avg`` propagates it)."""
    c = _as_col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def to_day(c, dtype: T.DataType | None = None) -> Column:
    """Observation date as DATE: timestamps are truncated, text must be
    ``yyyy-MM-dd`` (anything else becomes NULL and is dropped by the scan)."""
    c = _as_col(c)
    if isinstance(dtype, T.StringType):
        return F.try_to_date(c, "yyyy-MM-dd")
    return c.cast("date")
