"""Backtest: align predictions to labels, derive prices and errors, pivot."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import (
    ape, directional_loss, period_label, price_from_return, sign_agree,
)
from tidemark.operators._common import merged

PERIODS = ["train", "validation"]


def eval_rows(labels: DataFrame, preds: DataFrame | None, eval_boundary,
              keys: Iterable[str] = ()) -> DataFrame:
    """Labels ⟕ predictions on (keys, ssd, days_ahead), keep rows with both a
    prediction and a label, then actual/predicted price, APE, sign agreement
    and the period. (The left join followed by the not-null filter is planned
    as an inner join.) With ``preds=None`` the labels already carry a
    ``prediction`` column (fused plan, no join)."""
    keys = list(keys)
    on = keys + ["ssd", "days_ahead"]
    j = labels if preds is None else labels.join(merged(preds.select(*on, "prediction"), keys), on, "left")
    j = j.where(F.col("prediction").isNotNull() & F.col("y").isNotNull())
    return (j.withColumn("actual_price", price_from_return("current_spot_price", "y"))
             .withColumn("predicted_price", price_from_return("current_spot_price", "prediction"))
             .withColumn("ape", ape("predicted_price", "actual_price"))
             .withColumn("da", sign_agree("y", "prediction"))
             .withColumn("period", period_label("ssd", eval_boundary)))


def metric_pivot(rows: DataFrame, metric: str, keys: Iterable[str] = ()) -> DataFrame:
    """``days_ahead`` × period: mean and count of ``metric`` →
    ``train_mean, train_count, validation_mean, validation_count``. A period
    with no rows gives NULL for both. Explicit pivot values: no extra job."""
    keys = list(keys)
    return (rows.groupBy(*keys, "days_ahead").pivot("period", PERIODS)
            .agg(F.avg(metric).alias("mean"), F.count(metric).alias("count"))
            .select(*keys, "days_ahead",
                    *[F.col(f"{p}_{a}") for p in PERIODS for a in ("mean", "count")]))


def eval_summary(rows: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Long form per (keys, days_ahead, period): MAPE, DA, n and the
    directional loss over the whole group."""
    keys = list(keys)
    return (rows.groupBy(*keys, "days_ahead", "period")
            .agg(F.avg("ape").alias("mape"), F.avg("da").alias("da"),
                 F.count(F.lit(1)).alias("n"),
                 directional_loss(F.col("y"), F.col("prediction")).alias("directional_loss")))
