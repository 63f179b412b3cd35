"""Forecast attribution to (driver, lag step) and its per-driver summary.

For the linear backend the attribution is exact: with a background set B,
the interventional Shapley value (and the expected gradient) of input j is
``w_j · (x_j − mean_B x_j)``; the scores of a window add up to
``f(x) − mean_B f(b)``. Everything is an expression over the long rows of the
windows asked for.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators._common import beside, merged
from tidemark.operators.forecast.linear import pack_models


def sample_background(windows: DataFrame, n: int = 100, seed: int = 42,
                      keys: Iterable[str] = ()) -> DataFrame:
    """Up to ``n`` windows per series in a seeded pseudo-random order
    (``md5('<date>:<seed>')``): deterministic, and the same in any engine.
    The ``row_number() <= n`` filter is planned as a per-partition group
    limit ahead of the shuffle, so at most ``n`` rows per partition move."""
    keys = list(keys)
    h = F.md5(F.concat(F.date_format("ssd", "yyyy-MM-dd"), F.lit(f":{seed}")))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(h, F.col("ssd"))
    return windows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def step_means(rows: DataFrame, cols: Sequence[str], keys: Iterable[str] = ()) -> DataFrame:
    """``(keys…, step, <cols>…)``: mean of every column per lag step over the long
    window rows (``gather_rows``) of a background set."""
    return rows.groupBy(*keys, "step").agg(*[F.avg(c).alias(c) for c in cols])


def _with_models(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows beside the packed models of their series, one row per horizon."""
    side = pack_models(models, keys)
    joined = rows.join(beside(side, keys), keys) if keys else rows.crossJoin(F.broadcast(side))  # one row
    return joined.withColumn("m", F.explode("models")).drop("models")


def attribute_rows(rows: DataFrame, models: DataFrame | None, means: DataFrame, cols: Sequence[str],
                   keys: Iterable[str] = (), wide: bool = False) -> DataFrame:
    """Long scores ``(keys…, ssd, days_ahead, driver, lag_step, lag_date, score)``
    from long window rows ``(keys…, ssd, step, lag_date, <cols>…)``: each value is
    scored where it stands, no window is put together. ``means`` is
    ``step_means`` of the background. ``wide`` leaves the scores of a lag step side by
    side, one column per driver. Without ``models`` the rows are ``score_rows``'s with
    ``alongside``; a wide score keeps their part of the prediction."""
    keys = list(keys)
    mu = means.select(*keys, "step", *[F.col(c).alias(f"_mu_{c}") for c in cols])
    j = rows.join(beside(mu, keys), keys + ["step"])
    j = j if models is None else _with_models(j, models, keys)

    def score(i, c):
        weight = F.get(F.col("m.weights"), (F.col("step") * len(cols) + i).cast("int"))
        return weight * (F.col(c) - F.col(f"_mu_{c}"))

    at = [*keys, "ssd", F.col("m.days_ahead").alias("days_ahead"), F.col("step").alias("lag_step"), "lag_date"]
    if wide:
        return j.select(*at, *[score(i, c).alias(c) for i, c in enumerate(cols)],
                        *([] if models is not None else ["m.intercept", "part"]))
    each = [F.struct(F.lit(c).alias("driver"), score(i, c).alias("score")) for i, c in enumerate(cols)]
    return (j.select(*at, F.explode(F.array(*each)).alias("s"))
            .select(*keys, "ssd", "days_ahead", F.col("s.driver").alias("driver"), "lag_step", "lag_date",
                    F.col("s.score").alias("score")))


def _prediction():
    """The parts of a window's lag steps added up, with the intercept."""
    return (F.sum("part") + F.first("intercept")).alias("prediction")


def score_rows(rows: DataFrame, models: DataFrame, cols: Sequence[str], keys: Iterable[str] = (),
               alongside: bool = False) -> DataFrame:
    """Predictions ``(keys…, ssd, days_ahead, prediction)`` of the same long rows:
    the products of every lag step are added up per date and horizon. ``alongside``
    returns the rows with their model ``m`` and ``part`` instead, for
    ``attribute_rows``; ``attribution_summary`` then adds the parts up with the
    scores, and the rows are made once for both."""
    keys = list(keys)
    j = _with_models(rows, models, keys)
    part = sum((F.col(c).cast("double") * F.get(F.col("m.weights"), (F.col("step") * len(cols) + i).cast("int"))
                for i, c in enumerate(cols)), F.lit(0.0))
    if alongside:
        return j.withColumn("part", part)
    return (j.select(*keys, "ssd", "m.days_ahead", "m.intercept", part.alias("part"))
            .groupBy(*keys, "ssd", "days_ahead").agg(_prediction()))


def explode_rows(windows: DataFrame, cols: Sequence[str], keys: Iterable[str] = ()) -> DataFrame:
    """Long window rows of window arrays (``lag_windows(..., with_dates=True)``)."""
    keys = list(keys)
    return (windows.select(*keys, "ssd", "lag_dates", F.posexplode("x").alias("step", "_row"))
            .select(*keys, "ssd", "step", F.element_at("lag_dates", F.col("step") + 1).alias("lag_date"),
                    *[F.col("_row")[i].alias(c) for i, c in enumerate(cols)]))


def attribute_linear(windows: DataFrame, models: DataFrame, background: DataFrame,
                     cols: Sequence[str], keys: Iterable[str] = ()) -> DataFrame:
    """``attribute_rows`` for windows and background given as arrays."""
    means = step_means(explode_rows(background.withColumn("lag_dates", F.array().cast("array<date>"))
                                    if "lag_dates" not in background.columns else background, cols, keys), cols, keys)
    return attribute_rows(explode_rows(windows, cols, keys), models, means, cols, keys)


def _sum_of(cols):
    """Sum of the columns, as an aggregate of their rows would have it: NULLs are passed over."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))


def attribution_summary(scores: DataFrame, keys: Iterable[str] = (), cols: Sequence[str] = (),
                        wide: bool = False) -> DataFrame:
    """Per (keys, ssd, days_ahead, driver): ``total`` (signed sum over lag
    steps), ``abs_total`` and ``share`` of the absolute total of the date and
    horizon. With ``cols`` the scores are wide: a date and horizon is one group, and
    its drivers are exploded once they are summed, or with ``wide`` left side by side
    as structs of total, abs_total and share, beside the ``prediction`` where the
    scores have its parts."""
    keys = list(keys)
    if cols:
        scored = wide and "part" in scores.columns
        sums = scores.groupBy(*keys, "ssd", "days_ahead").agg(
            *([_prediction()] if scored else []), *[F.sum(c).alias(f"_t_{c}") for c in cols], *[F.sum(F.abs(c)).alias(f"_a_{c}") for c in cols])
        of = F.nullif(_sum_of(F.col(f"_a_{c}") for c in cols), F.lit(0.0))
        each = [F.struct(F.lit(c).alias("driver"), F.col(f"_t_{c}").alias("total"), F.col(f"_a_{c}").alias("abs_total"),
                         (F.col(f"_a_{c}") / of).alias("share")) for c in cols]
        if wide:
            return sums.select(*keys, "ssd", "days_ahead", *(["prediction"] if scored else []), *[e.alias(c) for e, c in zip(each, cols)])
        return sums.select(*keys, "ssd", "days_ahead", F.explode(F.array(*each)).alias("s")).select(
            *keys, "ssd", "days_ahead", "s.driver", "s.total", "s.abs_total", "s.share")
    s = scores.groupBy(*keys, "ssd", "days_ahead", "driver").agg(
        F.sum("score").alias("total"), F.sum(F.abs("score")).alias("abs_total"))
    w = Window.partitionBy(*keys, "ssd", "days_ahead")
    return s.withColumn("share", F.col("abs_total") / F.nullif(F.sum("abs_total").over(w), F.lit(0.0)))


# Our labels for the analyst context (the reference leaves them as
# placeholders): strength thresholds on a driver's share of all attribution.
STRONG_SHARE = 0.25
MODERATE_SHARE = 0.10


def driver_role(summary: DataFrame, path: DataFrame | None, keys: Iterable[str] = (),
                strong: float = STRONG_SHARE, moderate: float = MODERATE_SHARE, cols: Sequence[str] = ()) -> DataFrame:
    """``(keys…, ssd, driver, attribution_direction, forecast_direction, role,
    strength, share)``.

    attribution: UPWARD when the driver's total is positive at every horizon,
    DOWNWARD when negative at every horizon, else MIXED. forecast: sign of the
    last path price minus the current spot (UPWARD / DOWNWARD / FLAT). role:
    SUPPORTING when both point the same way, OPPOSING when opposite, else
    NEUTRAL. strength from the driver's share of all absolute attribution of
    the date: STRONG ≥ ``strong``, MODERATE ≥ ``moderate``, else LOW. ``cols``: the
    drivers of a wide summary, exploded last; without ``path`` its rows have the
    path's columns (``forecast_path`` with ``carry``) and nothing is joined."""
    keys = list(keys)
    ends = [F.max_by("forecast_price", "days_ahead").alias("_last"), F.first("current_spot").alias("_spot")]
    fdir = (F.when(F.col("_last") > F.col("_spot"), F.lit("UPWARD"))
            .when(F.col("_last") < F.col("_spot"), F.lit("DOWNWARD")).otherwise(F.lit("FLAT"))).alias("forecast_direction")

    def signs(total, name):
        return [F.sum(F.when(total > 0, 1).otherwise(0)).alias(f"_pos{name}"),
                F.sum(F.when(total < 0, 1).otherwise(0)).alias(f"_neg{name}")]

    if cols:
        d = summary.groupBy(*keys, "ssd").agg(
            F.count(F.lit(1)).alias("_n"), *[s for i, c in enumerate(cols) for s in signs(F.col(c)["total"], i)],
            *[F.sum(F.col(c)["abs_total"]).alias(f"_abs{i}") for i, c in enumerate(cols)], *([] if path is not None else ends))
        of = F.nullif(_sum_of(F.col(f"_abs{i}") for i in range(len(cols))), F.lit(0.0))
        d = d.select(*keys, "ssd", "_n", *([] if path is not None else [fdir]), F.array(*[
            F.struct(F.lit(c).alias("driver"), F.col(f"_pos{i}").alias("_pos"), F.col(f"_neg{i}").alias("_neg"),
                     (F.col(f"_abs{i}") / of).alias("share")) for i, c in enumerate(cols)]).alias("_each"))
    else:
        d = summary.groupBy(*keys, "ssd", "driver").agg(
            F.count(F.lit(1)).alias("_n"), *signs(F.col("total"), ""), F.sum("abs_total").alias("_abs"))
        d = d.withColumn("share", F.col("_abs") / F.nullif(
            F.sum("_abs").over(Window.partitionBy(*keys, "ssd")), F.lit(0.0)))
    adir = (F.when(F.col("_pos") == F.col("_n"), F.lit("UPWARD"))
            .when(F.col("_neg") == F.col("_n"), F.lit("DOWNWARD")).otherwise(F.lit("MIXED")))
    j = d
    if path is not None:
        fwd = path.groupBy(*keys, "ssd").agg(*ends)
        j = d.join(merged(fwd.select(*keys, "ssd", fdir), keys), keys + ["ssd"])
    if cols:
        j = j.select(*keys, "ssd", "_n", "forecast_direction", F.explode("_each").alias("_d")).select(
            *keys, "ssd", "_n", "forecast_direction", "_d.*")
    role = (F.when(F.col("attribution_direction").isin("UPWARD", "DOWNWARD")
                   & (F.col("attribution_direction") == F.col("forecast_direction")), F.lit("SUPPORTING"))
            .when(F.col("attribution_direction").isin("UPWARD", "DOWNWARD")
                  & F.col("forecast_direction").isin("UPWARD", "DOWNWARD"), F.lit("OPPOSING"))
            .otherwise(F.lit("NEUTRAL")))
    strength = (F.when(F.col("share") >= strong, F.lit("STRONG"))
                .when(F.col("share") >= moderate, F.lit("MODERATE")).otherwise(F.lit("LOW")))
    return (j.withColumn("attribution_direction", adir)
            .select(*keys, "ssd", "driver", "attribution_direction", "forecast_direction",
                    role.alias("role"), strength.alias("strength"), "share"))
