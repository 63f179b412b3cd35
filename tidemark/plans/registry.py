"""Registered queries: ``name → f(spark, sf_dir) → DataFrame``.

Each runs an engine operator over whole tables. Double outputs are rounded
to 6 places (an output convention shared with the SQL checks, because two
engines sum floating point values in different orders); arrays are exploded
to long rows for comparison.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.casts import to_real
from tidemark.functions.numeric import round_half_even
from tidemark.operators.align import align_sources, fill
from tidemark.operators.path import current_spot
from tidemark.operators.profile import LABEL_SCHEMA, StageCounts, profile_labels
from tidemark.session import by_series, materialize, scratch_path, series_parts
from tidemark.sources.artifacts import (
    check_model_shape, feature_order, load_bucketed, load_models, load_params, load_windows, save_bucketed, save_models,
    save_params, save_windows,
)
from tidemark.sources.scan import read_table, scan_prices, write_table
from tidemark.sources.snapshot import ingest_snapshot, read_snapshot
from tidemark.functions.dates import business_days, is_friday
from tidemark.operators.path import forecast_path
from tidemark.operators.requests import request_outcomes, validate_requests
from tidemark.operators.scale import apply_robust, fit_robust
from tidemark.operators.windows import (
    asof_rows, fit_split, gather_rows, lag_windows, recent_history, training_ends, training_set,
)
from tidemark.functions.numeric import directional_loss
from tidemark.operators.forecast.linear import fit_linear, predictions_wide, score_linear, score_sliding, train_samples
from tidemark.operators.attribution import (
    attribute_rows, attribution_summary, driver_role, sample_background, score_rows, step_means,
)
from tidemark.operators.order import row_numbers
from tidemark.operators.context import (
    SCORE_LABEL,
    driver_context, history_text, parse_insights, render_driver_context, render_report, report_context,
)
from tidemark.sources.dictionary import driver_dictionary, with_driver_info
from tidemark.operators.evaluate import eval_rows, eval_summary, metric_pivot
from tidemark.operators.forecast.baseline import baseline_predictions, with_baseline
from tidemark.operators.labels import future_return_vectors, future_returns
from tidemark.plans import jobs
from tidemark.plans import roles as R

DIGITS = 6
SHAPE = (R.LAG, len(R.FEATURES))
QUERIES: dict = {}


def query(fn=None, *, name: str | None = None):
    """Register ``fn`` under its name (or ``name``)."""
    def deco(f):
        QUERIES[name or f.__name__] = f
        return f
    return deco(fn) if fn is not None else deco


#: Where sums often end on a decimal tie, whose side depends on the order of
#: summation, both engines add this before they round.
OFF_TIES = 1e-9


def rounded(df: DataFrame, digits: int = DIGITS, off: float = 0.0) -> DataFrame:
    """Round every DOUBLE column (output convention of checked queries)."""
    return df.select(*[round_half_even(F.col(f.name) + off if off else F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


# ---- scans -----------------------------------------------------------------

@query
def spot_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.spot_one(spark, d))


# ---- labels, baseline, evaluation -----------------------------------------

def _labels_one(spark, d):
    return future_returns(R.spot_one(spark, d), R.HORIZON)


@query
def labels_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_labels_one(spark, d))


def _baseline_rows(spark, d, keys=()):
    """Labels and the baseline share one window pass; no join."""
    spot = R.spot_many(spark, d) if keys else R.spot_one(spark, d)
    spot = with_baseline(spot, R.LAG, keys)
    labels = future_returns(spot, R.HORIZON, keys, carry=["prediction"])
    return eval_rows(labels, None, R.EVAL_BOUNDARY, keys)


@query
def baseline_eval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eval_summary(_baseline_rows(spark, d)))


@query
def baseline_eval_many(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eval_summary(_baseline_rows(spark, d, R.KEYS), R.KEYS))


@query(name="eval_rows")
def eval_rows_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_baseline_rows(spark, d))


@query
def eval_mape(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_pivot(_baseline_rows(spark, d), "ape"))


@query
def eval_da(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_pivot(_baseline_rows(spark, d), "da"))



# ---- scans, pivot, merge, fills ---------------------------------------------

@query
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.index_long(spark, d))


@query
def index_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.index_wide(spark, d))


@query
def inventory_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.inventory(spark, d))


@query
def freight_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.freight(spark, d))


@query
def real_cast(spark: SparkSession, d: str) -> DataFrame:
    """Lenient text → number on text built from the orders table."""
    o = R.table(spark, d, "orders")
    price_txt = F.format_string("%.2f", "o_totalprice")
    return rounded(o.select(
        "o_orderkey",
        to_real("o_orderpriority").alias("r_priority"),
        to_real("o_orderstatus").alias("r_status"),
        to_real(F.concat(F.lit(" "), price_txt, F.lit("x"))).alias("r_padded"),
        to_real(F.regexp_replace(price_txt, r"\.", ",")).alias("r_comma"),
        to_real(F.concat(F.lit("."), F.substring(price_txt, 1, 2), F.lit("e2"))).alias("r_exp"),
        to_real(F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(
            F.col("o_orderstatus"))).alias("r_null"),
        to_real("o_orderpriority", mode="strict").alias("s_priority"),
        to_real(price_txt, mode="strict").alias("s_price")))


@query
def outer_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.merged_one(spark, d))


@query
def ffill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fill(R.merged_one(spark, d), R.FEATURES, how="ffill"))


@query
def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.frame_one(spark, d))


@query
def feature_frame_many(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.frame_many(spark, d))


@query
def feature_frame_union_many(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's frame on the union of all dates (what one series gets)."""
    return rounded(R.frame_union_many(spark, d))


@query(name="feature_order")
def feature_order_q(spark: SparkSession, d: str) -> DataFrame:
    """Feature order of the frame with each driver's count of known values
    before filling (a profile of the merged frame)."""
    merged = R.merged_one(spark, d)
    order = feature_order(merged)
    counts = merged.agg(*[F.count(c).alias(c) for c in R.FEATURES])
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("driver"), F.col(c).alias("n_known")) for c in R.FEATURES
    ])).alias("s")).select("s.driver", "s.n_known")
    return order.join(long, "driver").select("pos", "driver", "n_known")



@query
def label_profile(spark: SparkSession, d: str) -> DataFrame:
    """First date, distinct dates, rows and known labels of the label table."""
    return profile_labels(_labels_one(spark, d))


@query
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as CSV (header, ISO dates) and read back with the
    explicit label schema."""
    path = scratch_path(spark, f"csv-labels-{uuid.uuid4().hex}")
    write_table(_labels_one(spark, d), path, fmt="csv")
    return rounded(read_table(spark, path, LABEL_SCHEMA, fmt="csv"))


@query
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two forced refreshes of the orders table into a snapshot folder, then the
    spot scan over the version committed last."""
    out = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    for _ in range(2):
        ingest_snapshot(spark, d, out, ["orders"])
    return rounded(scan_prices(read_snapshot(spark, out, "orders"), "o_orderdate", "o_totalprice"))


def _text_orders(spark, d):
    """Orders as text: dates of one status spoilt, values of one priority not numbers."""
    price, day = F.format_string("%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return R.table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), day)).otherwise(day).alias("day"),
        F.when(F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).otherwise(price).alias("price"))


@query
def stage_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, unreadable dates, bad values and known values per stage from the text
    scan to the filled frame, observed while the tables are written."""
    counts = StageCounts()
    spot = scan_prices(_text_orders(spark, d), "day", "price", cast="strict", counts=counts, stage="spot_scan")
    spot = materialize(counts.watch(spot, "spot", price=F.count("price")), "spot")
    merged = counts.watch(align_sources([spot], [R.date_only(spark, d)]), "merged", **{c: F.count(c) for c in R.FEATURES})
    frame = counts.watch(fill(merged, R.FEATURES), "frame", **{c: F.count(c) for c in R.FEATURES})
    materialize(frame, "frame")
    labels = counts.watch(future_returns(spot, R.HORIZON), "labels", y=F.count("y"), predicted_for=F.count("predicted_for"))
    materialize(labels, "labels")
    return counts.table(spark)


@query(name="current_spot")
def current_spot_q(spark: SparkSession, d: str) -> DataFrame:
    """Spot price (2 places, half-even) for requested dates: every order date
    and the day after it; a date without a price gets status 'missing'."""
    return current_spot(R.spot_one(spark, d), _request_days(spark, d))



def _request_days(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ssd"))
    return o.union(o.select(F.date_add("ssd", 1).alias("ssd"))).where(F.col("ssd").isNotNull()).distinct()


# ---- windows, training set, scaling -----------------------------------------

def explode_windows(w: DataFrame, cols, keys=(), extra=()) -> DataFrame:
    """Window rows → long rows ``(keys…, ssd, step, [lag_date], <cols>…)``."""
    keys = list(keys)
    has_dates = "lag_dates" in w.columns
    base = w.select(*keys, "ssd", *extra, *(["lag_dates"] if has_dates else []),
                    F.posexplode("x").alias("step", "row"))
    out = [*keys, "ssd", *extra, "step"]
    if has_dates:
        out.append(F.element_at("lag_dates", F.col("step") + 1).alias("lag_date"))
    out += [F.col("row")[i].alias(c) for i, c in enumerate(cols)]
    return base.select(*out)


def _windows_one(spark, d, with_dates=True):
    return lag_windows(R.frame_one(spark, d), R.FEATURES, R.LAG, with_dates=with_dates)


def _samples_one(spark, d):
    return training_set(_windows_one(spark, d, with_dates=False), _labels_one(spark, d), R.TRAIN_CUTOFF)


@query(name="lag_windows")
def lag_windows_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explode_windows(_windows_one(spark, d), R.FEATURES))


def _windows_many(spark, d):
    return lag_windows(R.frame_many(spark, d), R.FEATURES, R.LAG, keys=R.KEYS, with_dates=True)


@query
def lag_windows_many(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every supplier as long rows, one per lag step."""
    return rounded(explode_windows(_windows_many(spark, d), R.FEATURES, R.KEYS))


@query
def lag_window_rows_many(spark: SparkSession, d: str) -> DataFrame:
    """The same long rows, under the name that the bench times."""
    return lag_windows_many(spark, d)


@query
def lag_window_sums_many(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every supplier as one row: its first date and, per driver, the
    sum of its values times their place in the window (1 for the oldest)."""
    steps = F.sequence(F.lit(0), F.lit(R.LAG - 1))

    def weighed(i):
        return F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.get(F.get("x", k), F.lit(i)) * (k + 1))

    sums = [weighed(i).alias(c) for i, c in enumerate(R.FEATURES)]
    return rounded(_windows_many(spark, d).select(*R.KEYS, "ssd", F.col("lag_dates")[0].alias("first_lag_date"), *sums), 3, off=1e-7)


def _probe_days(spark, d):
    o = R.table(spark, d, "orders").select(F.date_add(F.col("o_orderdate").cast("date"), 3).alias("ssd"))
    return o.where(F.col("ssd").isNotNull()).distinct()


@query
def asof_windows(spark: SparkSession, d: str) -> DataFrame:
    """Backward as-of: last 10 frame rows on or before each order date + 3."""
    return rounded(asof_rows(materialize(R.frame_one(spark, d), "frame_one"), _probe_days(spark, d), R.FEATURES, R.LAG))


@query(name="training_set")
def training_set_q(spark: SparkSession, d: str) -> DataFrame:
    """Label vectors of every sample (NULL slots kept) with the last price of
    its window (checks the window ↔ label alignment)."""
    s = _samples_one(spark, d)
    return rounded(s.select("ssd", "is_train", F.col("x")[R.LAG - 1][0].alias("x_last_price"),
                            F.posexplode("y").alias("k", "y"))
                   .select("ssd", "is_train", "x_last_price", (F.col("k") + 1).alias("days_ahead"), "y"))


@query
def train_split(spark: SparkSession, d: str) -> DataFrame:
    s = _samples_one(spark, d)
    return s.groupBy("is_train").agg(F.count(F.lit(1)).alias("n_samples"),
                                     F.min("ssd").alias("first_ssd"), F.max("ssd").alias("last_ssd"))


@query(name="fit_split")
def fit_split_q(spark: SparkSession, d: str) -> DataFrame:
    s = _samples_one(spark, d).where("is_train")
    return fit_split(s, 0.25).select("ssd", "is_val")


def _params_one(spark, d):
    """Frame (lineage cut once: it feeds the scaler, the windows and the
    samples) and scaler parameters fitted on the training windows."""
    frame = materialize(R.frame_one(spark, d), "frame_one")
    ends = training_ends(frame, R.spot_one(spark, d), R.LAG, R.TRAIN_CUTOFF)
    return frame, fit_robust(frame, R.FEATURES, R.LAG, ends)


@query
def robust_params(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_params_one(spark, d)[1])


@query
def scaled_windows(spark: SparkSession, d: str) -> DataFrame:
    frame, params = _params_one(spark, d)
    scaled = apply_robust(frame, params, R.FEATURES)
    return rounded(explode_windows(lag_windows(scaled, R.FEATURES, R.LAG, with_dates=True), R.FEATURES))


def _report_days(spark, d):
    """Fridays among the order dates (the report request dates)."""
    o = R.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ssd"))
    return o.where(F.col("ssd").isNotNull() & is_friday("ssd")).distinct()


@query(name="recent_history")
def recent_history_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_history_one(spark, d))


def _history_one(spark, d):
    """History of the report days; numbering and windows both read the frame, so
    it is written once."""
    frame = materialize(R.frame_one(spark, d), "frame_one")
    return recent_history(frame, R.FEATURES, _report_days(spark, d), R.LAG)


@query
def history_many(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's last 10 values of every driver on or before its own
    Fridays with a price."""
    spot = materialize(R.spot_many(spark, d), "spot_many")
    frame = materialize(R.frame_many(spark, d, spot), "frame_many")
    days = spot.where(is_friday("ssd")).select(*R.KEYS, "ssd")
    return rounded(recent_history(frame, R.FEATURES, days, R.LAG, R.KEYS))


# ---- linear forecaster, scoring, predictions ---------------------------------

def fixed_models(spark: SparkSession, dim: int, series: DataFrame | None = None) -> DataFrame:
    """A parameter table of known linear models (one per horizon, and per
    series when ``series`` is given): ``w[j] = (((7j + h) mod 11) − 5)/1000``,
    ``b = h/1000``. Used to check scoring against SQL independently of the
    fit."""
    hs = F.explode(F.sequence(F.lit(1), F.lit(R.HORIZON))).alias("days_ahead")
    base = series.select("series_id", hs) if series is not None else \
        spark.range(1).select(hs)
    return base.select(
        *(["series_id"] if series is not None else []), "days_ahead",
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                    lambda j: (((j * 7 + F.col("days_ahead")) % 11) - 5) / 1000.0).alias("weights"),
        (F.col("days_ahead") / 1000.0).alias("intercept"))


def _scaled_windows_one(spark, d):
    frame, params = _params_one(spark, d)
    return lag_windows(apply_robust(frame, params, R.FEATURES), R.FEATURES, R.LAG)


@query(name="score_linear")
def score_linear_q(spark: SparkSession, d: str) -> DataFrame:
    w = _scaled_windows_one(spark, d)
    return rounded(score_linear(w, fixed_models(spark, R.LAG * len(R.FEATURES))))



def _spot_by_series(spark, d):
    """Per-supplier spot, written once, its rows dealt by supplier, and the number of
    partitions: what is made of a supplier's rows later stays in its partition."""
    spot = materialize(R.spot_many(spark, d), "spot_many")  # one scan of the line table
    parts = series_parts(spot)
    return by_series(spot, R.KEYS, parts), parts


def _pipeline_many(spark, d, numbered=False):
    """Per-supplier spot, frame and scaler parameters, dealt by supplier. Only the
    spot rows are sent: the calendar joins them where they lie, so the frame is made
    anew for the scaler and the scaled rows; the parameters are written once.
    ``numbered``: spot and frame have row numbers, given while the rows are narrow."""
    spot, parts = _spot_by_series(spark, d)
    spot = row_numbers(spot, R.KEYS) if numbered else spot
    frame = R.frame_many(spark, d, spot)
    # windows look back only: rows from the cutoff on are in no training window
    past = frame.where(F.col("ssd") < F.lit(R.TRAIN_CUTOFF).cast("date"))
    params = fit_robust(past, R.FEATURES, R.LAG, training_ends(past, spot, R.LAG, R.TRAIN_CUTOFF, R.KEYS), keys=R.KEYS)
    return spot, frame, by_series(materialize(params, "params_many"), R.KEYS, parts), parts


@query
def robust_params_many(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pipeline_many(spark, d)[2])


@query
def predictions_long(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every supplier scored by the supplier's models (keyed path)."""
    spot, frame, params, _ = _pipeline_many(spark, d)
    series = spot.select(F.col("series_id").alias("series_id")).distinct()  # an attribute of its own for the co-group
    models = fixed_models(spark, R.LAG * len(R.FEATURES), series)
    return rounded(score_sliding(apply_robust(frame, params, R.FEATURES, keys=R.KEYS), models, R.FEATURES, R.LAG, R.KEYS))


@query(name="predictions_wide")
def predictions_wide_q(spark: SparkSession, d: str) -> DataFrame:
    w = _scaled_windows_one(spark, d)
    p = score_linear(w, fixed_models(spark, R.LAG * len(R.FEATURES)))
    return rounded(predictions_wide(p, R.HORIZON))


def _fit_one(spark, d):
    """Spot, scaled samples with their split, and the models fitted on them; the samples
    feed the fit and the backtest and are written once."""
    frame, params = _params_one(spark, d)
    spot = materialize(R.spot_one(spark, d), "spot")
    scaled = lag_windows(apply_robust(frame, params, R.FEATURES), R.FEATURES, R.LAG)
    samples = materialize(training_set(scaled, future_return_vectors(spot, R.HORIZON), R.TRAIN_CUTOFF), "samples")
    train = fit_split(samples.where("is_train"), 0.25)
    return spot, samples, train, materialize(fit_linear(train), "models")


@query(name="fit_linear")
def fit_linear_q(spark: SparkSession, d: str) -> DataFrame:
    """Ridge model per horizon (rows-only check: one model per horizon)."""
    return _fit_one(spark, d)[3].select("days_ahead", "n", "dim", F.size("weights").alias("n_weights"))


@query
def linear_eval(spark: SparkSession, d: str) -> DataFrame:
    """Backtest of the fitted linear models (rows-only check)."""
    spot, samples, _, models = _fit_one(spark, d)
    preds = score_linear(samples.select("ssd", "x"), models)
    return rounded(eval_summary(eval_rows(future_returns(spot, R.HORIZON), preds, R.EVAL_BOUNDARY)))


def _ridge(spark, d, keys=()):
    """Labels, scaled prices as windows of one step, and the models fitted on them:
    with one input the ridge solution has a closed form that SQL can state."""
    spot, parts = _spot_by_series(spark, d) if keys else (materialize(R.spot_one(spark, d), "spot"), 1)
    past = spot.where(F.col("ssd") < F.lit(R.TRAIN_CUTOFF).cast("date"))
    params = fit_robust(past, ["price"], 1, past.select(*keys, "ssd"), keys=keys)
    windows = lag_windows(apply_robust(spot, params, ["price"], keys=keys), ["price"], 1, keys)
    samples = training_set(windows, future_return_vectors(spot, R.HORIZON, keys), R.TRAIN_CUTOFF, keys)
    models = materialize(fit_linear(samples, keys, reg=R.RIDGE), "models")
    if keys:
        models = by_series(models, keys, parts)
    return future_returns(spot, R.HORIZON, keys), windows, models


def _ridge_models(spark, d, keys=()):
    models = _ridge(spark, d, keys)[2]
    return rounded(models.select(*keys, "days_ahead", F.col("weights")[0].alias("slope"), "intercept", "n", "dim"))


@query
def fit_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Fitted ridge models of the single series on its scaled price."""
    return _ridge_models(spark, d)


@query
def fit_ridge_many(spark: SparkSession, d: str) -> DataFrame:
    """Fitted ridge models of every supplier on its scaled price."""
    return _ridge_models(spark, d, R.KEYS)


@query
def ridge_eval_many(spark: SparkSession, d: str) -> DataFrame:
    """Per-supplier backtest of the fitted models: predictions are a table of
    their own and join the labels on series, date and horizon."""
    labels, windows, models = _ridge(spark, d, R.KEYS)
    preds = score_linear(windows, models, R.KEYS)
    return rounded(eval_summary(eval_rows(labels, preds, R.EVAL_BOUNDARY, R.KEYS), R.KEYS))


@query
def fit_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The fit on all inputs checked by what makes it the minimum: the gradient of the
    penalised error is zero in every weight and in the intercept (input -1)."""
    _, _, train, models = _fit_one(spark, d)
    known = (materialize(train_samples(train), "train").select("xf", F.posexplode("y").alias("k", "y")).where("y IS NOT NULL")
             .withColumn("days_ahead", F.col("k") + 1).join(F.broadcast(models), "days_ahead"))  # one model per horizon
    error = known.withColumn("e", F.aggregate(F.zip_with("xf", "weights", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v) - F.col("y"))
    each = error.select("days_ahead", "weights", "n", "e", F.posexplode(F.concat(F.array(F.lit(1.0)), "xf")).alias("i", "v"))
    pull = F.when(F.col("i") > 0, 1e-3 * F.get("weights", F.col("i") - 1)).otherwise(0.0)
    g = each.groupBy("days_ahead", "n", "i", pull.alias("pull")).agg((F.sum(F.col("e") * F.col("v")) / F.col("n")).alias("g"))
    return rounded(g.select("days_ahead", (F.col("i") - 1).alias("input"), "n", F.abs(F.col("g") + F.col("pull")).alias("gradient")))


@query
def momentum_eval(spark: SparkSession, d: str) -> DataFrame:
    """Backtest of the momentum baseline."""
    labels = future_returns(with_baseline(R.spot_one(spark, d), R.LAG, kind="momentum"), R.HORIZON, carry=["prediction"])
    return rounded(eval_summary(eval_rows(labels, None, R.EVAL_BOUNDARY)))


@query(name="directional_loss")
def directional_loss_q(spark: SparkSession, d: str) -> DataFrame:
    """MSE and the direction-penalised loss per horizon and period."""
    rows = _baseline_rows(spark, d)
    return rounded(rows.groupBy("days_ahead", "period").agg(
        F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse"),
        directional_loss(F.col("y"), F.col("prediction")).alias("directional_loss")))


# ---- calendar, forecast path, requests ---------------------------------------

@query(name="business_days")
def business_days_q(spark: SparkSession, d: str) -> DataFrame:
    """Next five weekdays after every order date, as dates and as text."""
    o = R.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ssd")) \
        .where(F.col("ssd").isNotNull()).distinct()
    return (o.select("ssd", F.posexplode(business_days("ssd", R.HORIZON)).alias("k", "bday"))
            .select("ssd", (F.col("k") + 1).alias("k"), "bday",
                    F.date_format("bday", "yyyy-MM-dd").alias("bday_text")))


def _path_one(spark, d):
    spot = R.spot_one(spark, d)
    preds = baseline_predictions(spot, R.HORIZON, R.LAG)
    return forecast_path(preds, current_spot(spot, _report_days(spark, d)), R.HORIZON)


@query(name="forecast_path")
def forecast_path_q(spark: SparkSession, d: str) -> DataFrame:
    """Rounded price path over the next business days for every Friday."""
    return rounded(_path_one(spark, d))


def _requests(spark, d):
    """Request strings derived from event timestamps: ISO days, slashed days,
    unpadded days, impossible days, days ten years back and three ahead, and
    raw property text."""
    ts = R.table(spark, d, "events").select("ts", "props")
    forms = [F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy/MM/dd"),
             F.date_format("ts", "yyyy-M-d"),
             F.concat(F.lit("2024-02-"), F.date_format("ts", "dd")),
             F.date_format(F.add_months("ts", -120), "yyyy-MM-dd"),
             F.date_format(F.add_months("ts", 36), "yyyy-MM-dd"), F.col("props")]
    return ts.select(F.explode(F.array(*forms)).alias("friday_date")).distinct()


@query
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate_requests(_requests(spark, d))


# ---- attribution -------------------------------------------------------------

def _attr_inputs(spark, d):
    """Rows of the report days' windows, the models, the lag-step means of the
    background set and its days. The scaled frame is numbered and written once;
    only the rows of these windows are read from it."""
    frame, params = _params_one(spark, d)
    scaled = materialize(row_numbers(apply_robust(frame, params, R.FEATURES)), "scaled")
    full = scaled.where(F.col("rn") >= R.LAG).select("ssd", "rn")
    report = full.join(_report_days(spark, d), "ssd", "left_semi")
    background = sample_background(full.join(R.spot_one(spark, d).select("ssd"), "ssd", "left_semi"), R.BACKGROUND_N, R.SEED)
    means = step_means(gather_rows(scaled, background, R.FEATURES, R.LAG), R.FEATURES)
    return gather_rows(scaled, report, R.FEATURES, R.LAG), fixed_models(spark, R.LAG * len(R.FEATURES)), means, background


def _scores_one(spark, d):
    report, models, means, _ = _attr_inputs(spark, d)
    return attribute_rows(report, models, means, R.FEATURES)


@query(name="background_sample")
def background_sample_q(spark: SparkSession, d: str) -> DataFrame:
    return _attr_inputs(spark, d)[3].select("ssd")


@query
def attribution_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scores_one(spark, d))


@query
def attribution_driver(spark: SparkSession, d: str) -> DataFrame:
    """Every driver's lag-step scores per horizon, labelled with the target
    business day. The score is left unrounded (beyond the shared 6 places): at 4
    places, integer-valued drivers sit on exact decimal ties."""
    s = _scores_one(spark, d)
    day = F.element_at(business_days("ssd", R.HORIZON), F.col("days_ahead"))
    return rounded(s.select("ssd", "days_ahead", "driver",
                            F.concat(F.lit(SCORE_LABEL), F.date_format(day, "yyyy-MM-dd")).alias("label"),
                            "lag_step", "lag_date", "score"))


@query(name="attribution_summary")
def attribution_summary_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(attribution_summary(_scores_one(spark, d)), off=OFF_TIES)


def _report_parts(spark, d):
    """Scores, forecast path, summary and roles of the report days; scores and path
    feed several branches each and are written once."""
    report, models, means, _ = _attr_inputs(spark, d)
    report = materialize(report, "report_rows")
    scores = materialize(attribute_rows(report, models, means, R.FEATURES), "scores")
    spot_now = current_spot(R.spot_one(spark, d), _report_days(spark, d))
    path = materialize(forecast_path(score_rows(report, models, R.FEATURES), spot_now, R.HORIZON), "path")
    summary = materialize(attribution_summary(scores), "summary")
    return scores, path, summary, driver_role(summary, path)


@query(name="driver_role")
def driver_role_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_report_parts(spark, d)[3])


def _attr_many(spark, d):
    """Window rows of every supplier's Fridays, the models, the lag-step means of the
    background sets and the spot."""
    spot, frame, params, _ = _pipeline_many(spark, d, numbered=True)
    scaled = apply_robust(frame, params, R.FEATURES, keys=R.KEYS)
    full = spot.select(*R.KEYS, "ssd", "rn").where(F.col("rn") >= R.LAG)  # the frame has the spot's rows
    report = gather_rows(scaled, full.where(is_friday("ssd")), R.FEATURES, R.LAG, R.KEYS, dealt=True)
    background = sample_background(full, R.BACKGROUND_N, R.SEED, R.KEYS)
    means = step_means(gather_rows(scaled, background, R.FEATURES, R.LAG, R.KEYS, dealt=True), R.FEATURES, R.KEYS)
    series = spot.select(F.col("series_id").alias("series_id")).distinct()
    return report, fixed_models(spark, R.LAG * len(R.FEATURES), series), means, spot


@query
def attribution_many(spark: SparkSession, d: str) -> DataFrame:
    """Attribution per supplier, Friday, horizon and driver."""
    report, models, means, _ = _attr_many(spark, d)
    scores = attribute_rows(report, models, means, R.FEATURES, R.KEYS, wide=True)
    return rounded(attribution_summary(scores, R.KEYS, R.FEATURES), off=OFF_TIES)


@query
def driver_role_many(spark: SparkSession, d: str) -> DataFrame:
    """Role labels per supplier, Friday and driver. The window rows are made once: the
    parts of the predictions go along with the scores until both are added up."""
    report, models, means, spot = _attr_many(spark, d)
    scored = score_rows(report, models, R.FEATURES, R.KEYS, alongside=True)
    scores = attribute_rows(scored, None, means, R.FEATURES, R.KEYS, wide=True)
    summary = attribution_summary(scores, R.KEYS, R.FEATURES, wide=True)
    days = spot.where(is_friday("ssd")).select(*R.KEYS, "ssd")
    path = forecast_path(summary, current_spot(spot, days, R.KEYS), R.HORIZON, R.KEYS, carry=R.FEATURES)
    return rounded(driver_role(path, None, R.KEYS, cols=R.FEATURES), off=OFF_TIES)


# ---- dictionary, context, report ---------------------------------------------

def _known_drivers(spark, d):
    """Drivers of the frame with their count of known values before filling."""
    merged = R.merged_one(spark, d)
    counts = merged.agg(*[F.count(c).alias(c) for c in R.FEATURES])
    return counts.select(F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("driver"), F.col(c).alias("n_known")) for c in R.FEATURES
    ])).alias("pos", "s")).select("pos", "s.driver", "s.n_known")


@query(name="driver_dictionary")
def driver_dictionary_q(spark: SparkSession, d: str) -> DataFrame:
    return with_driver_info(_known_drivers(spark, d), driver_dictionary(spark))


def _context_parts(spark, d):
    """Forecast path, roles and driver contexts of the report days."""
    scores, path, summary, roles = _report_parts(spark, d)
    roles = materialize(roles, "roles")
    ctx = driver_context(driver_dictionary(spark), _history_one(spark, d), path, summary, roles, scores=scores)
    return path, roles, materialize(ctx, "context")


def _context_one(spark, d):
    return _context_parts(spark, d)[2]


@query
def table_encode(spark: SparkSession, d: str) -> DataFrame:
    """Last 10 values of every driver before each Friday as compact text."""
    return history_text(_history_one(spark, d))


@query(name="driver_context")
def driver_context_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_context_one(spark, d))


@query
def context_render(spark: SparkSession, d: str) -> DataFrame:
    return render_driver_context(_context_one(spark, d))


def _role_insights(roles):
    """A complete insight as JSON for every row of the role table."""
    full = F.to_json(F.struct(
        F.col("driver").alias("feature_name"), F.col("attribution_direction").alias("feature_behavior"),
        F.col("role").alias("shap_interpretation"), F.col("forecast_direction").alias("forecast_alignment"),
        F.col("strength").alias("influence_strength"),
        F.concat_ws(" ", "driver", "role", "strength").alias("analyst_explanation")))
    return roles.select("ssd", "driver", full.alias("response"))


def _insight_texts(spark, d):
    """Insight JSON built from the role table (complete, cut short, in a code fence,
    between other text, with braces and quotes inside a field) and the raw event
    property text (valid JSON, none of the fields)."""
    rows = materialize(_role_insights(_report_parts(spark, d)[3]), "responses")
    cut = rows.select("ssd", "driver", F.regexp_replace("response", r"\}$", "").alias("response"))
    fenced = rows.withColumn("response", F.concat(F.lit("```json\n"), "response", F.lit("\n```")))
    told = rows.withColumn("response", F.concat(F.lit("The insight you asked for: "), "response", F.lit(" More on {driver} if needed.")))
    odd = rows.withColumn("response", F.concat(F.lit("Answer "), F.regexp_replace("response", '"feature_name":"', r'"feature_name":"}{\\"')))
    ev = R.table(spark, d, "events").select(F.col("ts").cast("date").alias("ssd"),
                                            F.lit("props").alias("driver"), F.col("props").alias("response"))
    return (rows.withColumn("variant", F.lit("full"))
            .unionByName(cut.withColumn("variant", F.lit("cut")))
            .unionByName(fenced.withColumn("variant", F.lit("fenced")))
            .unionByName(told.withColumn("variant", F.lit("told")))
            .unionByName(odd.withColumn("variant", F.lit("odd")))
            .unionByName(ev.withColumn("variant", F.lit("props"))))


@query
def insight_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse_insights(_insight_texts(spark, d), "response").drop("response")


def _reports_one(spark, d):
    """Reports of all Fridays; the insights are parsed from JSON of the strong and
    moderate roles, so that some drivers have none."""
    path, roles, ctx = _context_parts(spark, d)
    days = _report_days(spark, d)
    insights = parse_insights(_role_insights(roles.where("strength <> 'LOW'")), "response")
    return report_context(days, current_spot(R.spot_one(spark, d), days), path, ctx, insights, horizon=R.HORIZON)


@query(name="report_context")
def report_context_q(spark: SparkSession, d: str) -> DataFrame:
    """Report of every Friday, one row per driver (one without a driver for a
    Friday that has none)."""
    r = _reports_one(spark, d).withColumn("x", F.explode_outer("drivers"))
    return rounded(r.select("ssd", "current_spot", "forecast", "n_steps", "n_drivers", "n_insights", "is_valid", "reason",
                            "x.driver", "x.business_name", "x.role", "x.strength",
                            F.col("x.insight.analyst_explanation").alias("explanation")))


def _asked(spark, d):
    """Requests for every Friday, for the Fridays 20 years on and the Saturdays after."""
    asked = _report_days(spark, d).select(F.explode(F.array("ssd", F.date_add("ssd", 7 * 1043), F.date_add("ssd", 1))).alias("day"))
    return asked.select(F.date_format("day", "yyyy-MM-dd").alias("friday_date"))


@query
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """Every Friday's report as text."""
    return render_report(_reports_one(spark, d))


@query
def request_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of a request for every Friday, for the Fridays 20 years on and for
    the Saturdays after."""
    checked = validate_requests(_asked(spark, d), start=R.REQUEST_START, end=R.REQUEST_END)
    return request_outcomes(checked, _reports_one(spark, d))


# ---- scalable paths for one long series (same SQL as the global window) -----

@query
def feature_frame_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """The single-series frame filled block by block (two-pass fill)."""
    return rounded(fill(R.merged_one(spark, d), R.FEATURES, path="two_pass"))


@query
def lag_windows_halo(spark: SparkSession, d: str) -> DataFrame:
    """Single-series windows through row blocks with a halo (block of 256
    rows so the halo is exercised many times)."""
    from tidemark.operators.order import halo_lag_windows
    w = halo_lag_windows(R.frame_one(spark, d), R.FEATURES, R.LAG, block_rows=256, with_dates=True)
    return rounded(explode_windows(w, R.FEATURES))


@query
def robust_params_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Scaler parameters of the single series by narrowing histograms."""
    frame = materialize(R.frame_one(spark, d), "frame_one")
    ends = training_ends(frame, R.spot_one(spark, d), R.LAG, R.TRAIN_CUTOFF)
    return rounded(fit_robust(frame, R.FEATURES, R.LAG, ends, path="histogram"))


@query
def labels_halo(spark: SparkSession, d: str) -> DataFrame:
    """Single-series labels through row blocks with a forward halo."""
    return rounded(future_returns(R.spot_one(spark, d), R.HORIZON, path="halo"))


@query
def fit_split_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Chronological hold-out from the counts of date blocks."""
    s = _samples_one(spark, d).where("is_train").select("ssd")
    return fit_split(s, 0.25, path="blocks").select("ssd", "is_val")


# ---- artifacts and incremental ingest -------------------------------------------

@query
def windows_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Training set written partitioned by split and read back (train part
    only; the split column prunes the read to one folder)."""
    path = scratch_path(spark, f"windows-{uuid.uuid4().hex}")
    save_windows(_samples_one(spark, d), path)
    s = load_windows(spark, path, train_only=True)
    return rounded(s.select("ssd", "is_train", F.col("x")[R.LAG - 1][0].alias("x_last_price"),
                            F.posexplode("y").alias("k", "y"))
                   .select("ssd", "is_train", "x_last_price", (F.col("k") + 1).alias("days_ahead"), "y"))


@query
def frame_csv(spark: SparkSession, d: str) -> DataFrame:
    """The feature frame written as CSV and read back with its schema."""
    frame = R.frame_one(spark, d)
    path = scratch_path(spark, f"csv-frame-{uuid.uuid4().hex}")
    write_table(frame, path, fmt="csv")
    return rounded(read_table(spark, path, frame.schema, fmt="csv"))


@query
def windows_splits(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of the stored window dataset."""
    path = scratch_path(spark, f"windows-{uuid.uuid4().hex}")
    save_windows(_samples_one(spark, d), path)
    s = load_windows(spark, path)
    return rounded(s.select("ssd", "is_train", F.col("x")[R.LAG - 1][0].alias("x_last_price"), F.posexplode("y").alias("k", "y"))
                   .select("ssd", "is_train", "x_last_price", (F.col("k") + 1).alias("days_ahead"), "y"))


BUCKETS = 16  # at least; more as the rows grow


def bucketed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scaled windows and models of many series stored in buckets of the series, then
    scored: the join reads both in place. The buckets grow in number with the rows, so
    that none outgrows its task."""
    spot, frame, params, parts = _pipeline_many(spark, d)
    buckets = max(BUCKETS, parts)
    windows = lag_windows(apply_robust(frame, params, R.FEATURES, keys=R.KEYS), R.FEATURES, R.LAG, R.KEYS)
    models = fixed_models(spark, R.LAG * len(R.FEATURES), spot.select("series_id").distinct())
    held = {}
    for name, df in (("windows", windows), ("models", models)):
        run = f"{name}_{uuid.uuid4().hex}"
        path = scratch_path(spark, run)
        save_bucketed(df, run, path, R.KEYS, buckets)
        held[name] = load_bucketed(spark, run, path, R.KEYS, buckets)
    return score_linear(held["windows"], held["models"], R.KEYS)


@query
def predictions_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every supplier scored from bucketed tables."""
    return rounded(bucketed_scores(spark, d))


# ---- end-to-end jobs ------------------------------------------------------------

def _job_run(spark, d, last: str) -> str:
    """The experiment run up to a job, in a folder of its own."""
    out = scratch_path(spark, f"run-{uuid.uuid4().hex}")
    spot = materialize(R.spot_one(spark, d), "spot")
    steps = {
        "labels": lambda: jobs.labels_job(spot, out, R.HORIZON),
        "features": lambda: jobs.features_job([spot], [R.index_wide(spark, d), R.inventory(spark, d), R.freight(spark, d)], out),
        "training": lambda: jobs.training_job(spark, spot, out, R.LAG, R.HORIZON, R.TRAIN_CUTOFF),
        "fit": lambda: jobs.fit_job(spark, out, R.LAG),
        "report": lambda: jobs.report_job(spark, _asked(spark, d), spot, out, R.LAG, R.HORIZON, start=R.REQUEST_START, end=R.REQUEST_END),
    }
    for name, step in steps.items():
        step()
        if name == last:
            return out
    raise ValueError(last)


@query
def job_labels(spark: SparkSession, d: str) -> DataFrame:
    """Result of the label job (E1)."""
    return rounded(read_table(spark, f"{_job_run(spark, d, 'labels')}/labels"))


@query
def job_features(spark: SparkSession, d: str) -> DataFrame:
    """Result of the feature job (E2)."""
    return rounded(read_table(spark, f"{_job_run(spark, d, 'features')}/features"))


@query
def job_windows(spark: SparkSession, d: str) -> DataFrame:
    """Result of the training-set job (E3), both splits."""
    s = load_windows(spark, f"{_job_run(spark, d, 'training')}/windows")
    return rounded(s.select("ssd", "is_train", F.col("x")[R.LAG - 1][0].alias("x_last_price"), F.posexplode("y").alias("k", "y"))
                   .select("ssd", "is_train", "x_last_price", (F.col("k") + 1).alias("days_ahead"), "y"))


@query
def job_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Scaler of the fit job (E4)."""
    return rounded(load_params(spark, f"{_job_run(spark, d, 'fit')}/scaler"))


@query
def job_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Labels scored by the backtest job (E5) per horizon and period, from the models
    fitted before: how many rows it has and whether every error is there."""
    out = _job_run(spark, d, "fit")
    jobs.backtest_job(spark, out, R.LAG, R.EVAL_BOUNDARY)
    rows = read_table(spark, f"{out}/eval_rows")
    return rows.groupBy("days_ahead", "period").agg(F.count(F.lit(1)).alias("n"), F.count("ape").alias("n_ape"), F.count("da").alias("n_da"),
                                                    F.min("ssd").alias("first_ssd"), F.max("ssd").alias("last_ssd"))


@query
def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the report job (E6) from the fitted models."""
    return read_table(spark, f"{_job_run(spark, d, 'report')}/outcomes")


@query
def scaler_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Scaler parameters saved as a table and loaded back."""
    path = scratch_path(spark, f"scaler-{uuid.uuid4().hex}")
    save_params(_params_one(spark, d)[1], path)
    return rounded(load_params(spark, path))


@query
def model_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Per-horizon models saved partitioned by horizon, loaded back (numeric
    horizon order), checked against the window shape and used to score."""
    path = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    save_models(fixed_models(spark, R.LAG * len(R.FEATURES))
                .withColumn("dim", F.lit(R.LAG * len(R.FEATURES))), path)
    models = check_model_shape(load_models(spark, path), R.LAG * len(R.FEATURES))
    return rounded(score_linear(_scaled_windows_one(spark, d), models))


@query
def snapshot_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders files ingested by the streaming landing-file ingest, then the
    spot scan over the snapshot."""
    from tidemark.streaming import ingest_stream
    schema = R.table(spark, d, "orders").schema
    run = uuid.uuid4().hex
    out = ingest_stream(spark, f"{d.rstrip('/')}/orders*.parquet", schema,
                        scratch_path(spark, f"stream-out-{run}"), scratch_path(spark, f"stream-ckpt-{run}"))
    return rounded(scan_prices(spark.read.parquet(out), "o_orderdate", "o_totalprice"))
