"""Reference-free baseline forecasters (pure window expressions).

``mean_reversion``: the return that would bring the price back to the mean
of the last ``lag`` prices; ``momentum``: the return of the last ``lag - 1``
steps carried forward. Both need a complete window of ``lag`` rows.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import safe_div
from tidemark.operators._common import series_window, trailing


def with_baseline(spot: DataFrame, lag: int = 10, keys: Iterable[str] = (),
                  price: str = "price", kind: str = "mean_reversion") -> DataFrame:
    """Adds ``prediction`` (NULL until a full window of ``lag`` rows)."""
    keys = list(keys)
    w = trailing(keys, lag)
    n = F.count(F.lit(1)).over(w)
    if kind == "mean_reversion":
        pred = safe_div(F.avg(price).over(w), price) - F.lit(1.0)
    elif kind == "momentum":
        pred = safe_div(F.col(price), F.lag(price, lag - 1).over(series_window(keys))) - F.lit(1.0)
    else:
        raise ValueError(f"unknown baseline {kind!r}")
    return spot.withColumn("prediction", F.when(n == lag, pred))


def baseline_predictions(spot: DataFrame, horizon: int = 5, lag: int = 10,
                         keys: Iterable[str] = (), price: str = "price",
                         kind: str = "mean_reversion") -> DataFrame:
    """Long predictions ``(keys…, ssd, days_ahead, prediction)``; the same
    return is forecast for every horizon."""
    keys = list(keys)
    return (with_baseline(spot, lag, keys, price, kind)
            .where(F.col("prediction").isNotNull())
            .select(*keys, "ssd", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("days_ahead"),
                    "prediction"))
