"""Column-level helpers: all built-in Spark expressions (codegen, no Python)."""

from tidemark.functions.casts import to_real, to_day, nan_to_null  # noqa: F401
from tidemark.functions.dates import business_days, strict_date, is_friday  # noqa: F401
from tidemark.functions.numeric import (  # noqa: F401
    future_return, price_from_return, ape, sign_agree, period_label,
    directional_loss, safe_div, round_half_even,
)
from tidemark.functions.text import fmt_fixed, render_table  # noqa: F401
