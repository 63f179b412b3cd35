"""End-to-end batch jobs (the experiment run and the report request), each a
composition of operators that writes its outputs as Parquet tables under
``out``. Jobs hand over through tables, never through the driver."""

from __future__ import annotations

import os
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.align import align_sources, fill
from tidemark.operators.attribution import (
    attribute_linear, attribution_summary, driver_role, sample_background,
)
from tidemark.operators.context import driver_context, parse_insights, render_driver_context, render_report, report_context
from tidemark.operators.evaluate import eval_rows, eval_summary, metric_pivot
from tidemark.operators.forecast.linear import fit_linear, score_linear
from tidemark.operators.labels import future_return_vectors, future_returns
from tidemark.operators.path import current_spot, forecast_path
from tidemark.operators.requests import request_outcomes, validate_requests
from tidemark.operators.scale import apply_robust, fit_robust
from tidemark.operators.windows import fit_split, lag_windows, recent_history, training_set
from tidemark.sources.artifacts import check_model_shape, feature_order, load_models, save_models, save_params, save_windows
from tidemark.sources.dictionary import driver_dictionary
from tidemark.sources.scan import read_table, write_table


def _p(out: str, name: str) -> str:
    return os.path.join(out, name)


def labels_job(spot: DataFrame, out: str, horizon: int = 5, keys: Iterable[str] = ()) -> str:
    """E1: forward-return labels of every observed spot date."""
    path = _p(out, "labels")
    write_table(future_returns(spot, horizon, keys), path)
    return path


def features_job(series_sources: Sequence[DataFrame], global_sources: Sequence[DataFrame], out: str,
                 keys: Iterable[str] = ()) -> str:
    """E2: aligned and filled feature frame, plus its feature order."""
    keys = list(keys)
    merged = align_sources(series_sources, global_sources, keys, calendar="own" if keys else "union")
    cols = [c for c in merged.columns if c not in keys and c != "ssd"]
    path = _p(out, "features")
    write_table(fill(merged, cols, keys), path)
    write_table(feature_order(merged, exclude=keys + ["ssd"]), _p(out, "feature_order"))
    return path


def training_job(spark: SparkSession, spot: DataFrame, out: str, lag: int, horizon: int,
                 train_cutoff, keys: Iterable[str] = (), embargo: bool = False) -> str:
    """E3: window dataset ``(keys, ssd, x, y, is_train)`` partitioned by split."""
    keys = list(keys)
    frame = read_table(spark, _p(out, "features"))
    cols = [r.driver for r in read_table(spark, _p(out, "feature_order")).orderBy("pos").collect()]
    samples = training_set(lag_windows(frame, cols, lag, keys), future_return_vectors(spot, horizon, keys),
                           train_cutoff, keys, embargo)
    path = _p(out, "windows")
    save_windows(samples, path)
    return path


def fit_job(spark: SparkSession, out: str, lag: int, keys: Iterable[str] = (),
            val_fraction: float = 0.25, **opts) -> str:
    """E4: scaler (fitted on the training windows), scaled samples and one
    model per horizon (and series)."""
    keys = list(keys)
    frame = read_table(spark, _p(out, "features"))
    cols = [r.driver for r in read_table(spark, _p(out, "feature_order")).orderBy("pos").collect()]
    samples = read_table(spark, _p(out, "windows")).withColumn(
        "is_train", F.col("is_train").cast("string") == F.lit("true"))
    ends = samples.where("is_train").select(*keys, "ssd")
    params = fit_robust(frame, cols, lag, ends, keys)
    save_params(params, _p(out, "scaler"))
    params = read_table(spark, _p(out, "scaler"))
    scaled = lag_windows(apply_robust(frame, params, cols, keys), cols, lag, keys)
    scaled_samples = scaled.join(samples.select(*keys, "ssd", "y", "is_train"), keys + ["ssd"])
    write_table(scaled_samples, _p(out, "scaled_windows"))
    scaled_samples = read_table(spark, _p(out, "scaled_windows"))
    train = fit_split(scaled_samples.where("is_train"), val_fraction, keys)
    path = _p(out, "models_linear")
    save_models(fit_linear(train, keys, **opts), path)
    return path


def backtest_job(spark: SparkSession, out: str, lag: int, eval_boundary, keys: Iterable[str] = ()) -> dict[str, str]:
    """E5: predictions for every window, evaluation rows, MAPE and DA pivots
    and the long summary (persisted, unlike the source, which only logs)."""
    keys = list(keys)
    windows = read_table(spark, _p(out, "scaled_windows"))
    cols = read_table(spark, _p(out, "feature_order")).count()
    preds = score_linear(windows, check_model_shape(load_models(spark, _p(out, "models_linear")), lag * cols), keys)
    write_table(preds, _p(out, "predictions"))
    rows = eval_rows(read_table(spark, _p(out, "labels")), read_table(spark, _p(out, "predictions")),
                     eval_boundary, keys)
    write_table(rows, _p(out, "eval_rows"))
    rows = read_table(spark, _p(out, "eval_rows"))
    paths = {}
    for name, df in [("eval_mape", metric_pivot(rows, "ape", keys)), ("eval_da", metric_pivot(rows, "da", keys)),
                     ("eval_summary", eval_summary(rows, keys))]:
        write_table(df, _p(out, name))
        paths[name] = _p(out, name)
    return paths


def report_job(spark: SparkSession, requests: DataFrame, spot: DataFrame, out: str, lag: int, horizon: int,
               keys: Iterable[str] = (), start: str | None = None, end: str | None = None,
               background_n: int = 100, seed: int = 42, responses: DataFrame | None = None) -> dict[str, str]:
    """E6: validate the requested dates, then per valid date and driver (and
    series, for every series with a spot on that date) the forecast path,
    attribution, role labels, history and the rendered context; one
    report-context row per date (and series), complete or not, and one outcome
    row per request. A date that is requested twice is computed once.
    ``responses`` (keys, ssd, driver, response) is insight JSON, collected in
    the reports."""
    keys = list(keys)
    kw = {k: v for k, v in (("start", start), ("end", end)) if v}
    checked = validate_requests(requests, **kw)
    write_table(checked, _p(out, "requests"))
    days = read_table(spark, _p(out, "requests")).where("is_valid").select(F.col("report_date").alias("ssd")).distinct()
    if keys:
        days = days.join(spot.select(*keys, "ssd").distinct(), "ssd").select(*keys, "ssd")
    frame = read_table(spark, _p(out, "features"))
    cols = [r.driver for r in read_table(spark, _p(out, "feature_order")).orderBy("pos").collect()]
    params = read_table(spark, _p(out, "scaler"))
    models = check_model_shape(load_models(spark, _p(out, "models_linear")), lag * len(cols))
    scaled = lag_windows(apply_robust(frame, params, cols, keys), cols, lag, keys, with_dates=True)
    samples = read_table(spark, _p(out, "windows")).select(*keys, "ssd")
    report = scaled.join(days, keys + ["ssd"], "left_semi")
    background = sample_background(scaled.join(samples, keys + ["ssd"], "left_semi"), background_n, seed, keys)
    write_table(attribute_linear(report, models, background, cols, keys), _p(out, "attribution"))
    scores = read_table(spark, _p(out, "attribution"))
    summary = attribution_summary(scores, keys)
    spot_now = current_spot(spot, days, keys)
    write_table(forecast_path(score_linear(report, models, keys), spot_now, horizon, keys), _p(out, "paths"))
    path = read_table(spark, _p(out, "paths"))
    roles = driver_role(summary, path, keys)
    history = recent_history(frame, cols, days, lag, keys)
    ctx = driver_context(driver_dictionary(spark), history, path, summary, roles, keys, scores)
    write_table(ctx, _p(out, "driver_context"))
    ctx = read_table(spark, _p(out, "driver_context"))
    write_table(render_driver_context(ctx, keys), _p(out, "driver_prompts"))
    insights = parse_insights(responses) if responses is not None else None
    write_table(report_context(days, spot_now, path, ctx, insights, keys, horizon), _p(out, "report_context"))
    write_table(render_report(read_table(spark, _p(out, "report_context")), keys), _p(out, "reports"))
    write_table(request_outcomes(read_table(spark, _p(out, "requests")), read_table(spark, _p(out, "report_context"))),
                _p(out, "outcomes"))
    return {n: _p(out, n) for n in ("requests", "outcomes", "paths", "driver_context", "driver_prompts", "report_context", "reports")}
