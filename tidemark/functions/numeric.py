"""Arithmetic of returns, prices and forecast errors (guarded divisions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b with NULL for a zero divisor (ANSI mode raises on x/0)."""
    return _as_col(a) / F.nullif(_as_col(b), F.lit(0.0))


def future_return(future, now) -> Column:
    """Simple return ``(future - now) / now``."""
    return safe_div(_as_col(future) - _as_col(now), now)


def price_from_return(price, ret) -> Column:
    """``price * r + price``."""
    p = _as_col(price)
    return p * _as_col(ret) + p


def ape(predicted_price, actual_price) -> Column:
    """Absolute percentage error, relative to the (signed) actual price."""
    return safe_div(F.abs(_as_col(predicted_price) - _as_col(actual_price)), actual_price)


def sign_agree(a, b) -> Column:
    """1 when both values have the same sign (both zero counts), else 0."""
    return F.when(F.signum(_as_col(a)) == F.signum(_as_col(b)), F.lit(1)).otherwise(F.lit(0))


def period_label(ssd, boundary) -> Column:
    """'validation' on and after the boundary date, else 'train'."""
    return F.when(_as_col(ssd) >= F.lit(boundary).cast("date"), F.lit("validation")) \
        .otherwise(F.lit("train"))


def directional_loss(y, p) -> Column:
    """Aggregate: mean squared error scaled by 2 / (1 + share of equal signs)."""
    y, p = _as_col(y), _as_col(p)
    agree = F.when(F.signum(y) == F.signum(p), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.avg(F.pow(y - p, 2)) * F.lit(2.0) / (F.lit(1.0) + F.avg(agree))


def round_half_even(c, digits: int = 0) -> Column:
    """Half-to-even rounding of the binary value scaled by 10^digits
    (``rint(x·10ⁿ)/10ⁿ``, NumPy's rule). ``bround`` instead rounds the
    shortest decimal text, which differs when that text ends in a 5 the
    binary value does not reach."""
    c = _as_col(c)
    if digits == 0:
        return F.rint(c)
    f = float(10 ** digits)
    return F.rint(c * F.lit(f)) / F.lit(f)
