"""Current spot lookups and the forecast price path."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import business_days
from tidemark.functions.numeric import price_from_return, round_half_even
from tidemark.operators._common import merged


def current_spot(spot: DataFrame, dates: DataFrame, keys: Iterable[str] = (),
                 price: str = "price") -> DataFrame:
    """``(keys…, ssd, current_spot, status)`` for every requested date: the
    price rounded to 2 places half-to-even, or NULL with status 'missing'
    (the error of a point lookup becomes a column). ``spot`` has one row per
    date (scans de-duplicate)."""
    keys = list(keys)
    j = dates.select(*keys, "ssd").join(merged(spot.select(*keys, "ssd", price), keys), keys + ["ssd"], "left")
    return j.select(*keys, "ssd", round_half_even(price, 2).alias("current_spot"),
                    F.when(F.col(price).isNull(), F.lit("missing")).otherwise(F.lit("ok")).alias("status"))


def forecast_path(preds: DataFrame, spot_now: DataFrame, horizon: int,
                  keys: Iterable[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """``(keys…, ssd, days_ahead, future_date, forecast_price, current_spot, <carry>…)``.

    The return forecast is rounded to 2 places, turned into a price from the
    rounded current spot and rounded to a whole number (half-to-even); the
    k-th horizon is paired with the k-th business day after the date.
    ``spot_now`` is ``current_spot`` output (status 'ok' rows are used).
    """
    keys = list(keys)
    s = spot_now.where(F.col("status") == "ok").select(*keys, "ssd", "current_spot")
    j = preds.join(merged(s, keys), keys + ["ssd"])
    price = price_from_return(F.col("current_spot"), round_half_even("prediction", 2))
    return j.select(*keys, "ssd", "days_ahead",
                    F.element_at(business_days("ssd", horizon), F.col("days_ahead")).alias("future_date"),
                    round_half_even(price, 0).cast("long").alias("forecast_price"), "current_spot", *carry)
