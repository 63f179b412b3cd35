"""Long→wide pivot, multi-source alignment on the date axis, gap filling."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators._common import series_window


def pivot_drivers(long_df: DataFrame, drivers: Sequence[str], keys: Iterable[str] = ()) -> DataFrame:
    """``(keys…, ssd, driver, value)`` → ``(keys…, ssd, <driver>…)`` with the
    mean per cell. NULL values are removed first, so a date whose every value
    is missing disappears. The driver list is explicit: fixed column order,
    no extra distinct job, and only listed drivers are read.

    Planned as one conditional aggregate per driver over a single
    ``groupBy(keys, ssd)``: one shuffle with a map-side partial aggregate
    (``pivot()`` would first group by (date, driver) and shuffle twice)."""
    keys = list(keys)
    drivers = list(drivers)
    src = long_df.where(F.col("value").isNotNull() & F.col("driver").isin(drivers))
    return src.groupBy(*keys, "ssd").agg(*[
        F.avg(F.when(F.col("driver") == F.lit(c), F.col("value"))).alias(c) for c in drivers])


def outer_merge(frames: Sequence[DataFrame], keys: Iterable[str] = ()) -> DataFrame:
    """Full outer merge on ``keys + ssd`` (USING join: the key is coalesced).
    NULL dates never reach here (dropped at scan)."""
    on = list(keys) + ["ssd"]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on, "full_outer")
    return out


def global_calendar(global_frame: DataFrame) -> DataFrame:
    """The date-only sources as one row per calendar day over their own span,
    each column forward filled (back filled before its first value), with ``_pos``,
    the number of dates of the sources up to the day, and ``_real``, whether the day
    is one.

    Built from the date-only sources alone (never from the per-series
    tables) and checkpointed, so that the planner knows its size.
    """
    from tidemark.session import materialize

    span = global_frame.agg(F.min("ssd").alias("lo"), F.max("ssd").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("ssd"))
    cols = [c for c in global_frame.columns if c != "ssd"]
    real = days.join(global_frame.withColumn("_real", F.lit(True)), "ssd", "left").fillna(False, ["_real"])
    w = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return materialize(fill(real, cols).withColumn("_pos", F.count(F.when(F.col("_real"), 1)).over(w)))


def align_sources(series_frames: Sequence[DataFrame], global_frames: Sequence[DataFrame] = (),
                  keys: Iterable[str] = (), calendar: str = "union") -> DataFrame:
    """Align per-series sources and date-only sources into one frame.

    No keys (one series): everything is full-outer merged on ``ssd``; the
    frame holds the union of all dates (``calendar="union"``), as the
    single-series pipeline expects.

    With keys (many series, ``calendar="own"``): each series keeps its own
    dates. The date-only sources become a daily calendar (``global_calendar``)
    whose value on day *t* is the last known value at or before *t*; each
    series row takes the calendar row of its date clamped into the calendar
    span (before the span → first values, after it → last values). Equals the
    union-calendar fill restricted to the series' own dates.
    """
    keys = list(keys)
    s = outer_merge(series_frames, keys)
    if not global_frames:
        return s
    g = outer_merge(global_frames)
    if not keys:
        if calendar != "union":
            raise ValueError("one series always uses the union calendar")
        return outer_merge([s, g])
    if calendar not in ("own", "union"):
        raise ValueError(f"unknown calendar {calendar!r}")
    cal = global_calendar(g)
    gcols = [c for c in cal.columns if c not in ("ssd", "_real", "_pos")]
    # the calendar's span is one row; the join of the calendar itself is chosen
    # from the file sizes of the checkpointed table
    span = cal.agg(F.min("ssd").alias("_lo"), F.max("ssd").alias("_hi"))
    day = F.least(F.greatest(F.col("ssd"), F.col("_lo")), F.col("_hi"))
    joined = (s.crossJoin(F.broadcast(span)).withColumn("_cal_day", day)
              .join(cal.withColumnRenamed("ssd", "_cal_day"), "_cal_day", "left"))
    if calendar == "union":
        return _gap_dates(joined, cal, keys, [c for c in s.columns if c not in keys and c != "ssd"], gcols)
    return joined.select(*keys, "ssd", *[c for c in s.columns if c not in keys and c != "ssd"], *gcols)


def _gap_dates(own: DataFrame, cal: DataFrame, keys: list[str], scols: list[str], gcols: list[str]) -> DataFrame:
    """The rows of ``own`` (joined with their calendar day) and, between each and the
    next of its series, before the first and behind the last, the calendar's real
    dates. Each row is exploded into the positions of its gap, which then fetch
    their day: as many rows as the result has, never series times days."""
    total = cal.agg(F.max("_pos").alias("_total"))
    real = F.when(F.col("_real"), 1).otherwise(0)
    before, after = F.col("ssd") < F.col("_lo"), F.col("ssd") > F.col("_hi")
    d = (own.crossJoin(F.broadcast(total))  # one row
         .withColumn("_le", F.when(before, 0).otherwise(F.col("_pos")))
         .withColumn("_lt", F.when(before, 0).when(after, F.col("_total")).otherwise(F.col("_pos") - real)))
    w = series_window(keys)
    d = (d.withColumn("_first", F.row_number().over(w) == 1)
         .withColumn("_to", F.coalesce(F.lead("_lt").over(w), F.col("_total"))))

    def run(lo, hi, when):
        return F.when(when & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    spots = F.concat(F.array(zero), run(one, F.col("_lt"), F.col("_first")), run(F.col("_le") + 1, F.col("_to"), F.lit(True)))
    gaps = d.select(*keys, "ssd", *scols, *gcols, F.explode(spots).alias("_i"))
    days = cal.where("_real").select(F.col("_pos").alias("_i"), F.col("ssd").alias("_day"), *[F.col(c).alias(f"_g_{c}") for c in gcols])
    mine = F.col("_i") == 0
    return gaps.join(days, "_i", "left").select(
        *keys, F.coalesce("_day", "ssd").alias("ssd"), *[F.when(mine, F.col(c)).alias(c) for c in scols],
        *[F.when(mine, F.col(c)).otherwise(F.col(f"_g_{c}")).alias(c) for c in gcols])


def fill(df: DataFrame, cols: Iterable[str], keys: Iterable[str] = (),
         how: str = "ffill_bfill", path: str = "window") -> DataFrame:
    """Forward fill each column in date order, then (``ffill_bfill``) fill the
    leading gap with the first known value. ``ffill`` alone never looks
    ahead. Both frames use the same partition/order spec: one sort.
    ``path="two_pass"`` fills inside date blocks and carries block edges
    (for a series too long for one task; same result)."""
    keys = list(keys)
    cols = list(cols)
    if path == "two_pass":
        from tidemark.operators.order import two_pass_fill
        return two_pass_fill(df, cols, keys, how)
    w = series_window(keys)
    fwd = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # after the forward fill only the head is open, and the first known value of
    # the whole series closes it: one pass, where a frame that shrinks towards
    # the end would be summed up anew for every row
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = []
    for c in df.columns:
        if c in cols:
            v = F.last(c, ignorenulls=True).over(fwd)
            if how == "ffill_bfill":
                v = F.coalesce(v, F.first(c, ignorenulls=True).over(whole))
            elif how != "ffill":
                raise ValueError(f"unknown fill {how!r}")
            out.append(v.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
