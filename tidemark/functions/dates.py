"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def business_days(d, h: int) -> Column:
    """ARRAY<DATE> of the next ``h`` weekdays strictly after ``d`` (no holiday
    calendar). A span of ceil(h/5) weeks plus one always holds h weekdays."""
    d = _as_col(d)
    span = math.ceil(h / 5) * 7 + 7
    days = F.sequence(F.date_add(d, 1), F.date_add(d, span))
    return F.slice(F.filter(days, lambda x: F.weekday(x) < 5), 1, h)


def strict_date(s) -> Column:
    """Strict ``YYYY-MM-DD`` text → DATE, NULL when malformed or impossible."""
    s = _as_col(s)
    return F.when(s.rlike(_ISO_DAY), F.try_to_date(s, "yyyy-MM-dd"))


def is_friday(d) -> Column:
    return F.weekday(_as_col(d)) == 4
