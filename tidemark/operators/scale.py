"""Robust scaling (median / inter-quartile range) fitted on window rows."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators._common import beside, merged, series_window


def window_weights(frame: DataFrame, ends: DataFrame, lag: int, keys: Iterable[str] = ()) -> DataFrame:
    """Adds ``m``: how many of the given window ends lie in the next ``lag``
    rows (the current row included), i.e. how many fitted windows contain
    this row. Percentiles weighted by ``m`` equal percentiles over the
    stacked windows without materialising them (lag× less data)."""
    keys = list(keys)
    e = ends.select(*keys, "ssd").distinct().withColumn("_end", F.lit(1))
    w = series_window(keys).rowsBetween(Window.currentRow, lag - 1)
    return (frame.join(merged(e, keys), keys + ["ssd"], "left")
            .withColumn("m", F.sum(F.coalesce(F.col("_end"), F.lit(0))).over(w).cast("long"))
            .drop("_end"))


def fit_robust(frame: DataFrame, cols: Sequence[str], lag: int, ends: DataFrame,
               keys: Iterable[str] = (), q: tuple[float, float] = (0.25, 0.75), path: str = "buffer") -> DataFrame:
    """Scaler parameters ``(keys…, driver, center, scale)``: exact weighted
    median and ``q75 − q25`` (linear interpolation) of every driver over all
    rows of the fitted windows; a zero range becomes 1. ``path="buffer"`` sorts a
    driver's values of one series in one aggregate; ``"histogram"`` finds the same
    values by narrowing histograms (for a driver with more values than a task holds)."""
    keys = list(keys)
    weighted = window_weights(frame, ends, lag, keys).where(F.col("m") > 0)

    def each(value):
        return F.explode(F.array(*[F.struct(F.lit(c).alias("driver"), value(c)) for c in cols])).alias("d")

    def buffered(v):
        return F.percentile(F.col(v).cast("double"), F.array(F.lit(q[0]), F.lit(0.5), F.lit(q[1])), F.col("m"))

    if keys and path != "histogram":
        # a series' drivers side by side: the rows are not exploded, and a task has one group per series
        p = weighted.groupBy(*keys).agg(*[buffered(c).alias(c) for c in cols])
        p = p.select(*keys, each(lambda c: F.col(c).alias("qs"))).select(*keys, "d.driver", "d.qs")
    else:
        long = weighted.select(*keys, "m", each(lambda c: F.col(c).cast("double").alias("v"))).select(*keys, "m", "d.driver", "d.v")
        if path == "histogram":
            from tidemark.operators.quantiles import exact_quantiles
            p = exact_quantiles(long, (q[0], 0.5, q[1]), [*keys, "driver"])
        else:
            p = long.groupBy("driver").agg(buffered("v").alias("qs"))
    rng = F.col("qs")[2] - F.col("qs")[0]
    return p.select(*keys, "driver", F.col("qs")[1].alias("center"),
                    F.when(rng == 0, F.lit(1.0)).otherwise(rng).alias("scale"))


def apply_robust(frame: DataFrame, params: DataFrame, cols: Sequence[str],
                 keys: Iterable[str] = ()) -> DataFrame:
    """``(v − center) / scale`` per driver. Parameters are one small row per
    series (broadcast when there are no keys: a single row)."""
    keys = list(keys)
    wide = params.groupBy(*keys).pivot("driver", list(cols)).agg(
        F.first("center").alias("c"), F.first("scale").alias("s"))
    if keys:
        j = frame.join(beside(wide, keys), keys, "left")
    else:
        j = frame.withColumn("_one", F.lit(1)).join(
            F.broadcast(wide.withColumn("_one", F.lit(1))), "_one").drop("_one")
    out = [F.col(c) for c in frame.columns if c not in cols]
    out += [((F.col(c) - F.col(f"{c}_c")) / F.col(f"{c}_s")).alias(c) for c in cols]
    return j.select(*out).select(*frame.columns)
