"""Text rendering of small per-group tables and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_fixed(c, digits: int) -> Column:
    """Fixed-point text of a number already rounded to ``digits`` places."""
    c = F.col(c) if isinstance(c, str) else c
    if digits == 0:
        return F.format_string("%d", c.cast("long"))
    return F.format_string(f"%.{digits}f", c)


def render_table(rows: Column, n: Column, columns: list[str]) -> Column:
    """Compact table text: a header ``[n]{c1,c2}:`` then one indented line of
    comma-separated values per row. ``rows`` is an ARRAY<STRING> of rendered
    lines, already in order."""
    header = F.concat(F.lit("["), n.cast("string"), F.lit("]{" + ",".join(columns) + "}:"))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("  "), r)), "\n")
    return F.when(n > 0, F.concat_ws("\n", header, body)).otherwise(header)
