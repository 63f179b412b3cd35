"""Forward-return labels for horizons 1…H."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import future_return
from tidemark.operators._common import series_window


def future_returns(spot: DataFrame, horizon: int = 5, keys: Iterable[str] = (),
                   price: str = "price", carry: Iterable[str] = (), path: str = "window") -> DataFrame:
    """``(keys…, ssd, current_spot_price, predicted_for, days_ahead, y)``.

    Horizon *d* looks *d* observed rows ahead (the next observed dates, not
    calendar days). Every date gets H rows; those without a future keep a
    NULL ``predicted_for`` and ``y``. All H ``lead``s share one window (one
    sort) and one ``explode`` replaces H copies + a union. ``carry`` columns
    (e.g. a per-date prediction from the same window) ride along, so a
    backtest needs no join back to the labels. ``path="halo"`` looks ahead inside
    row blocks that hold the first rows of the next one (for a series too long for
    one task; same result).
    """
    keys = list(keys)
    carry = list(carry)
    if path == "halo":
        from tidemark.operators.order import halo_leads
        spot = halo_leads(spot, ["ssd", price], horizon, keys)
        per_h = [F.struct(F.lit(d).alias("days_ahead"), F.col("_ahead")[d - 1]["ssd"].alias("predicted_for"),
                          F.col("_ahead")[d - 1][price].alias("future")) for d in range(1, horizon + 1)]
    else:
        w = series_window(keys)
        per_h = [F.struct(F.lit(d).alias("days_ahead"),
                          F.lead("ssd", d).over(w).alias("predicted_for"),
                          F.lead(price, d).over(w).alias("future"))
                 for d in range(1, horizon + 1)]
    return (spot.select(*keys, "ssd", F.col(price).alias("current_spot_price"), *carry,
                        F.array(*per_h).alias("_hs"))
            .select(*keys, "ssd", "current_spot_price", *carry, F.explode("_hs").alias("h"))
            .select(*keys, "ssd", "current_spot_price", *carry,
                    F.col("h.predicted_for").alias("predicted_for"),
                    F.col("h.days_ahead").alias("days_ahead"),
                    future_return("h.future", "current_spot_price").alias("y")))


def future_return_vectors(spot: DataFrame, horizon: int = 5, keys: Iterable[str] = (),
                          price: str = "price") -> DataFrame:
    """``(keys…, ssd, y ARRAY<DOUBLE>, last_target DATE)``: the label vector of
    every date (horizon order, NULL slots kept) straight from the spot series
    in one window pass, without exploding and regrouping long labels."""
    keys = list(keys)
    w = series_window(keys)
    ys = [future_return(F.lead(price, d).over(w), F.col(price)) for d in range(1, horizon + 1)]
    return spot.select(*keys, "ssd", F.array(*ys).alias("y"),
                       F.lead("ssd", horizon).over(w).alias("last_target"))
