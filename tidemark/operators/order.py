"""Scalable paths for a series too long for one task.

A per-series window puts all rows of a series in one task. A daily series
is bounded by its calendar, but a single series can still outgrow a task
(sub-daily grain, decades of history times many drivers). These paths
split one series into buckets and give exactly the same results:

* ``global_row_number``: row numbers without a single-partition sort: rows
  are bucketed by date block, each block is numbered locally and shifted by
  the running count of earlier blocks (a tiny table of one row per block).
* ``halo_lag_windows``: rows are grouped in blocks of ``B`` consecutive row
  numbers; the last ``lag - 1`` rows of a block are copied into the next
  block (the halo), windows are computed inside blocks and only each row's
  home block is kept.
* ``two_pass_fill``: forward/backward fill inside date blocks, then each
  block's gap at its edges is closed from the last (first) known value of
  the earlier (later) blocks, carried over the small block table.

* ``last_rows``: how many rows of a frame lie on or before a probe date, counted
  inside date blocks and shifted the same way.
* ``halo_leads``: the mirror image of the halo, the first rows of a block are
  copied into the block before, so looking ahead stays inside a block.
* ``block_split``: a series' tail by row number and total, without a window over
  the whole series.

All need a total order on ``ssd`` within a series (one row per date, as the
scans produce).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Date-block width (days) for numbering and filling; a block holds at most
# this many rows of one series.
BLOCK_DAYS = 366


def _block(ssd: Column, days: int) -> Column:
    return F.floor(F.datediff(ssd, F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("long")


def _w(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def _with_offset(d: DataFrame, count: Column, keys: list[str]) -> DataFrame:
    """Adds ``_off``: the sum of ``count`` over all earlier date blocks of the
    series (from a table of one row per block)."""
    counts = d.groupBy(*keys, "_blk").agg(count.alias("_cnt"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        _w(keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(offsets.select(*keys, "_blk", "_off"), keys + ["_blk"])


def global_row_number(df: DataFrame, keys: Iterable[str] = (), block_days: int = BLOCK_DAYS) -> DataFrame:
    """Adds ``rn`` (1-based, by ``ssd`` within keys) computed per date block."""
    keys = list(keys)
    d = df.withColumn("_blk", _block(F.col("ssd"), block_days))
    local = F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy("ssd"))
    return (_with_offset(d.withColumn("_lrn", local), F.count(F.lit(1)), keys)
            .withColumn("rn", F.col("_off") + F.col("_lrn"))
            .drop("_blk", "_lrn", "_off"))


def row_numbers(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Adds ``rn``: one sorted window per series, or by date blocks where there is
    one series only (no task then holds it whole)."""
    keys = list(keys)
    if not keys:
        return global_row_number(df)
    return df.withColumn("rn", F.row_number().over(_w(keys).orderBy("ssd")).cast("long"))


def last_rows(frame: DataFrame, probes: DataFrame, keys: Iterable[str] = (), block_days: int = BLOCK_DAYS) -> DataFrame:
    """``(keys…, ssd, rn)`` of the probes: the number of the last frame row dated on
    or before each; probes before the first row are left out. The frame's dates and
    the probes are merged in date order and the frame's rows counted along it, per
    series, or per date block plus the earlier blocks where there is one series."""
    keys = list(keys)
    merged = (frame.select(*keys, "ssd", F.lit(0).alias("_probe"))
              .unionByName(probes.select(*keys, "ssd").distinct().withColumn("_probe", F.lit(1))))
    row = F.when(F.col("_probe") == 0, 1)
    by = list(keys)
    if not keys:
        merged = merged.withColumn("_blk", _block(F.col("ssd"), block_days))
        by = ["_blk"]
    along = Window.partitionBy(*by).orderBy("ssd", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = merged.withColumn("rn", F.count(row).over(along))
    if not keys:
        counted = _with_offset(counted, F.count(row), keys).withColumn("rn", F.col("rn") + F.col("_off"))
    return counted.where((F.col("_probe") == 1) & (F.col("rn") > 0)).select(*keys, "ssd", "rn")


def halo_leads(df: DataFrame, cols: Sequence[str], ahead: int, keys: Iterable[str] = (),
               block_rows: int = 4096) -> DataFrame:
    """Adds ``_ahead``: for each of the next ``ahead`` rows a struct of ``cols``
    (NULL behind the last row), oldest first, from windows over blocks of
    ``block_rows`` rows."""
    keys = list(keys)
    if block_rows < ahead:
        raise ValueError("block_rows must be at least the rows looked ahead")
    home = F.floor((F.col("rn") - 1) / F.lit(block_rows)).cast("long")
    pos = (F.col("rn") - 1) % F.lit(block_rows)
    targets = F.when(pos < F.lit(ahead), F.array(home, home - 1)).otherwise(F.array(home))
    copies = global_row_number(df, keys).withColumn("_home", home).withColumn("_b", F.explode(targets))
    w = Window.partitionBy(*keys, "_b").orderBy("ssd")
    nxt = F.array(*[F.struct(*[F.lead(c, k).over(w).alias(c) for c in cols]) for k in range(1, ahead + 1)])
    return copies.withColumn("_ahead", nxt).where(F.col("_b") == F.col("_home")).drop("rn", "_home", "_b")


def block_split(df: DataFrame, fraction: float, keys: Iterable[str] = ()) -> DataFrame:
    """Adds ``is_val`` for the last ``fraction`` of each series by row number and
    total, both from block counts."""
    keys = list(keys)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = global_row_number(df, keys)
    joined = numbered.join(total, keys) if keys else numbered.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("is_val", F.col("rn") > F.floor(F.col("_n") * F.lit(1.0 - fraction))).drop("rn", "_n")


def halo_lag_windows(frame: DataFrame, cols: Sequence[str], lag: int, keys: Iterable[str] = (),
                     block_rows: int = 4096, with_dates: bool = False) -> DataFrame:
    """Same output as ``lag_windows`` (complete windows only) without ever
    sorting a whole series in one task."""
    keys = list(keys)
    if block_rows < lag:
        raise ValueError("block_rows must be at least lag")
    n = global_row_number(frame, keys)
    home = F.floor((F.col("rn") - 1) / F.lit(block_rows)).cast("long")
    pos = (F.col("rn") - 1) % F.lit(block_rows)
    # every row belongs to its home block; the last lag-1 rows of a block are
    # also copied into the next block as its halo
    targets = F.when(pos >= F.lit(block_rows - (lag - 1)), F.array(home, home + 1)).otherwise(F.array(home))
    copies = n.withColumn("_home", home).withColumn("_b", F.explode(targets))
    w = Window.partitionBy(*keys, "_b").orderBy("ssd").rowsBetween(-(lag - 1), Window.currentRow)
    sel = [*keys, "ssd", "_home", "_b",
           F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w).alias("x"),
           F.count(F.lit(1)).over(w).alias("_n")]
    if with_dates:
        sel.append(F.collect_list("ssd").over(w).alias("lag_dates"))
    out = copies.select(*sel).where((F.col("_b") == F.col("_home")) & (F.col("_n") == lag))
    return out.drop("_home", "_b", "_n")


def two_pass_fill(df: DataFrame, cols: Sequence[str], keys: Iterable[str] = (),
                  how: str = "ffill_bfill", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Same output as ``fill`` with every window bounded by a date block."""
    keys = list(keys)
    cols = list(cols)
    d = df.withColumn("_blk", _block(F.col("ssd"), block_days))
    wb = Window.partitionBy(*keys, "_blk").orderBy("ssd")
    local = d.select(*[F.col(c) for c in df.columns], "_blk",
                     *[F.last(c, ignorenulls=True).over(
                         wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_f_{c}")
                       for c in cols],
                     *[F.first(c, ignorenulls=True).over(
                         wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_b_{c}")
                       for c in cols])
    # one row per block: its last and first known value of every column
    edge = d.groupBy(*keys, "_blk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ssd"))).alias(f"_l_{c}") for c in cols],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ssd"))).alias(f"_e_{c}") for c in cols])
    wk = _w(keys).orderBy("_blk")
    carry = edge.select(*keys, "_blk",
                        *[F.last(f"_l_{c}", ignorenulls=True).over(
                            wk.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cf_{c}") for c in cols],
                        *[F.first(f"_e_{c}", ignorenulls=True).over(
                            wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_cb_{c}")
                          for c in cols])
    j = local.join(carry, keys + ["_blk"], "left")
    out = []
    for c in df.columns:
        if c in cols:
            v = F.coalesce(F.col(f"_f_{c}"), F.col(f"_cf_{c}"))
            if how == "ffill_bfill":
                v = F.coalesce(v, F.col(f"_b_{c}"), F.col(f"_cb_{c}"))
            out.append(v.alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)
