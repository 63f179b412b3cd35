"""Lag windows, as-of windows, training sets, chronological splits, history."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_even
from tidemark.operators._common import beside, merged, series_window, trailing


def lag_windows(frame: DataFrame, cols: Sequence[str], lag: int = 10, keys: Iterable[str] = (),
                with_dates: bool = False, complete: bool = True, path: str = "window",
                carry: Sequence[str] = ()) -> DataFrame:
    """``(keys…, ssd, <carry>…, x ARRAY<ARRAY<DOUBLE>>[, lag_dates])``: the ``lag``
    rows ending at each row, oldest first, drivers in ``cols`` order. Only full
    windows are kept unless ``complete=False``. One sorted window pass; no
    per-date rescans. ``path="halo"`` splits each series into row blocks
    with a halo (for a series too long for one task; same result)."""
    keys = list(keys)
    if path == "halo":
        if not complete or carry:
            raise ValueError("the halo path returns complete windows only and carries no columns")
        from tidemark.operators.order import halo_lag_windows
        return halo_lag_windows(frame, cols, lag, keys, with_dates=with_dates)
    w = trailing(keys, lag)
    sel = [*keys, "ssd", *carry,
           F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w).alias("x"),
           F.count(F.lit(1)).over(w).alias("_n")]
    if with_dates:
        sel.append(F.collect_list("ssd").over(w).alias("lag_dates"))
    out = frame.select(*sel)
    # Completeness is tested on a row count, not on size(x), so plans that
    # only need window dates never build the arrays (column pruning).
    if complete:
        out = out.where(F.col("_n") == lag)
    return out.drop("_n")


def gather_rows(frame: DataFrame, ends: DataFrame, cols: Sequence[str], n: int,
                keys: Iterable[str] = (), dealt: bool = False) -> DataFrame:
    """``(keys…, ssd, step, lag_date, <cols>…)``: the ``n`` rows of ``frame`` (which
    has row numbers ``rn``) up to row ``rn`` of each ``(keys…, ssd, rn)`` of
    ``ends``, oldest first, fewer where the series begins. Only these rows are
    joined, by series and number; no window is built for any other date. ``dealt``:
    both sides lie in partitions of bounded size (``by_series``); a task then hashes
    the numbers it wants and the frame's rows pass by unsorted."""
    keys = list(keys)
    first = F.greatest(F.col("rn") - (n - 1), F.lit(1))
    want = ends.select(*keys, "ssd", F.posexplode(F.sequence(first, F.col("rn"))).alias("step", "rn"))
    held = frame.select(*keys, "rn", F.col("ssd").alias("lag_date"), *cols)
    joined = held.join(beside(want, keys), keys + ["rn"]) if dealt else want.join(merged(held, keys), keys + ["rn"])
    return joined.select(*keys, "ssd", "step", "lag_date", *cols)


def training_ends(frame: DataFrame, label_days: DataFrame, lag: int, train_cutoff, keys: Iterable[str] = ()) -> DataFrame:
    """``(keys…, ssd)`` of the training samples: frame rows before the cutoff that end
    a complete window and have a label row. Only dates are read; what a scaler needs
    of the training set are its dates, not its windows."""
    from tidemark.operators.order import row_numbers
    keys = list(keys)
    past = frame.select(*keys, "ssd").where(F.col("ssd") < F.lit(train_cutoff).cast("date"))
    return (row_numbers(past, keys).where(F.col("rn") >= lag)
            .join(merged(label_days.select(*keys, "ssd").distinct(), keys), keys + ["ssd"], "left_semi").select(*keys, "ssd"))


def asof_rows(frame: DataFrame, dates: DataFrame, cols: Sequence[str], n: int,
              keys: Iterable[str] = ()) -> DataFrame:
    """For every probe date the last ``n`` frame rows dated on or before it
    (backward as-of, row count based), as long rows ``(keys…, ssd, step, lag_date,
    <cols>…)``. Probe dates need not be frame dates."""
    from tidemark.operators.order import last_rows, row_numbers
    keys = list(keys)
    return gather_rows(row_numbers(frame, keys), last_rows(frame, dates, keys), cols, n, keys)


def asof_last_n(frame: DataFrame, dates: DataFrame, cols: Sequence[str], n: int,
                keys: Iterable[str] = ()) -> DataFrame:
    """``asof_rows`` as one row per probe: ``(keys…, ssd, x, lag_dates)``; windows
    may be short. A group is at most ``n`` rows."""
    keys = list(keys)
    rows = asof_rows(frame, dates, cols, n, keys)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    g = rows.groupBy(*keys, "ssd").agg(F.array_sort(F.collect_list(F.struct("step", "lag_date", x.alias("x")))).alias("_r"))
    return g.select(*keys, "ssd", F.transform("_r", lambda r: r["x"]).alias("x"),
                    F.transform("_r", lambda r: r["lag_date"]).alias("lag_dates"))


def label_vectors(labels: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """``(keys…, ssd, y ARRAY<DOUBLE>, last_target DATE)``: the label vector of
    a date ordered by horizon. Structs are collected so NULL labels keep their
    slot (``collect_list`` of bare values would drop them)."""
    keys = list(keys)
    return (labels.groupBy(*keys, "ssd")
            .agg(F.array_sort(F.collect_list(F.struct("days_ahead", "y"))).alias("_ys"),
                 F.max("predicted_for").alias("last_target"))
            .select(*keys, "ssd", F.transform("_ys", lambda s: s["y"]).alias("y"), "last_target"))


def training_set(windows: DataFrame, labels: DataFrame, train_cutoff,
                 keys: Iterable[str] = (), embargo: bool = False) -> DataFrame:
    """Windows ⋈ label vectors on ``(keys, ssd)`` with ``is_train = ssd <
    cutoff`` (with ``embargo`` also every target date before the cutoff).
    Windows of dates without labels are not samples. ``labels`` is either the
    long label table or vectors from ``future_return_vectors``."""
    keys = list(keys)
    vectors = labels if "y" in labels.columns and "days_ahead" not in labels.columns \
        else label_vectors(labels, keys)
    cutoff = F.lit(train_cutoff).cast("date")
    is_train = F.col("ssd") < cutoff
    if embargo:
        is_train = is_train & (F.col("last_target") < cutoff)
    return (windows.join(merged(vectors, keys), keys + ["ssd"])
            .select(*keys, "ssd", "x", "y", F.coalesce(is_train, F.lit(False)).alias("is_train")))


def fit_split(samples: DataFrame, fraction: float = 0.25, keys: Iterable[str] = (),
              path: str = "window") -> DataFrame:
    """Chronological hold-out: the last ``fraction`` of each series' samples
    (by date) is validation, ``is_val = rn > floor(n · (1 − fraction))``.
    ``path="blocks"`` numbers date blocks (for a series too long for one task;
    same result)."""
    keys = list(keys)
    if path == "blocks":
        from tidemark.operators.order import block_split
        return block_split(samples, fraction, keys)
    w = series_window(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys) if keys else Window.partitionBy())
    rn = F.row_number().over(w)
    return samples.withColumn("is_val", rn > F.floor(n * F.lit(1.0 - fraction)))


def recent_history(frame: DataFrame, cols: Sequence[str], dates: DataFrame, n: int = 10,
                   keys: Iterable[str] = (), digits: int = 2) -> DataFrame:
    """Long history ``(keys…, ssd, driver, step, hist_date, value)``: the last
    ``n`` rows on or before each probe date for every driver (step 0 is the
    oldest), values rounded half-to-even."""
    keys = list(keys)
    each = F.array(*[F.struct(F.lit(c).alias("driver"), F.col(c).cast("double").alias("value")) for c in cols])
    return (asof_rows(frame, dates, cols, n, keys)
            .select(*keys, "ssd", "step", F.col("lag_date").alias("hist_date"), F.explode(each).alias("d"))
            .select(*keys, "ssd", F.col("d.driver").alias("driver"), "step", "hist_date",
                    round_half_even(F.col("d.value"), digits).alias("value")))
