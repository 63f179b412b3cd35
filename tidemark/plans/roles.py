"""How the driver's TPC-H-like tables play the engine's sources.

Each function returns a DataFrame over the whole table; all derived columns
are built from the table itself so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.align import align_sources, fill, pivot_drivers
from tidemark.sources.scan import scan_long_index, scan_prices, scan_series

# Fixed run parameters of the checked queries.
HORIZON = 5
LAG = 10
TRAIN_CUTOFF = "2000-01-01"
EVAL_BOUNDARY = "2000-07-01"
BACKGROUND_N = 100
RIDGE = 1e-3
SEED = 42
REQUEST_START, REQUEST_END = "1990-01-01", "2010-12-31"
# Index classes (return flag _ line status), the excluded one, and the
# driver order of the frame.
INDEX_DRIVERS = ["A_F", "A_O", "N_O", "R_F", "R_O"]
EXCLUDED_DRIVER = "N_F"
FEATURES = ["price", *INDEX_DRIVERS, "inventory", "freight"]
KEYS = ["series_id"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def spot_one(spark: SparkSession, d: str) -> DataFrame:
    """One series: mean order total per order date → ``(ssd, price)``."""
    return scan_prices(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


def spot_many(spark: SparkSession, d: str) -> DataFrame:
    """Many series: mean line price per supplier and ship date →
    ``(series_id, ssd, price)``."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "series_id")
    return scan_prices(li, "l_shipdate", "l_extendedprice", keys=KEYS)


def index_long(spark: SparkSession, d: str) -> DataFrame:
    """Long index table ``(ssd, driver, value)`` with one class excluded."""
    li = table(spark, d, "lineitem")
    return scan_long_index(li, "l_shipdate", F.concat("l_returnflag", F.lit("_"), "l_linestatus"),
                           "l_extendedprice", exclude=[EXCLUDED_DRIVER])


def index_wide(spark: SparkSession, d: str) -> DataFrame:
    return pivot_drivers(index_long(spark, d), INDEX_DRIVERS)


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Daily total quantity → ``(ssd, inventory)`` (one row per date)."""
    li = table(spark, d, "lineitem")
    daily = li.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("q"))
    return scan_series(daily, "day", "q", out="inventory", dedupe="none")


def _sparse_tax():
    """Tax of first lines from 1996 on: the values of the sparse role; all other
    lines of the table are its missing values."""
    known = (F.col("l_linenumber") == 1) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return F.avg(F.when(known, F.col("l_tax").cast("double")))


def freight(spark: SparkSession, d: str) -> DataFrame:
    """Sparse daily series starting a year late → ``(ssd, freight)``."""
    li = table(spark, d, "lineitem")
    daily = li.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(_sparse_tax().alias("t")).where("t is not null")
    return scan_series(daily, "day", "t", out="freight", dedupe="none")


def date_only(spark: SparkSession, d: str) -> DataFrame:
    """The index classes, the inventory and the freight series side by side, from
    one scan: they share the table and the grain, so one aggregate makes the rows
    that merging the three on the date makes."""
    day = F.col("l_shipdate").cast("date")
    cls = F.concat("l_returnflag", F.lit("_"), "l_linestatus")
    return table(spark, d, "lineitem").where(day.isNotNull()).groupBy(day.alias("ssd")).agg(
        *[F.avg(F.when(cls == c, F.col("l_extendedprice").cast("double"))).alias(c) for c in INDEX_DRIVERS],
        F.sum("l_quantity").cast("double").alias("inventory"),
        _sparse_tax().alias("freight"))


def merged_one(spark: SparkSession, d: str) -> DataFrame:
    """Four sources full-outer merged on the date (before filling)."""
    return align_sources([spot_one(spark, d)], [index_wide(spark, d), inventory(spark, d),
                                                freight(spark, d)])


def frame_one(spark: SparkSession, d: str) -> DataFrame:
    """The single-series feature frame, filled forward then backward. The date-only
    drivers come from one scan; ``merged_one`` merges the same rows from a scan each."""
    return fill(align_sources([spot_one(spark, d)], [date_only(spark, d)]), FEATURES)


def frame_many(spark: SparkSession, d: str, spot: DataFrame | None = None) -> DataFrame:
    """Per-supplier feature frame on each supplier's own dates with the
    date-only drivers attached from the daily calendar. ``spot``: an already
    computed ``spot_many`` (so callers that also need labels scan once)."""
    return align_sources([spot if spot is not None else spot_many(spark, d)], [date_only(spark, d)],
                         keys=KEYS, calendar="own")


def frame_union_many(spark: SparkSession, d: str, spot: DataFrame | None = None) -> DataFrame:
    """Per-supplier frame on the union of its own dates and those of the date-only
    drivers, filled per supplier."""
    merged = align_sources([spot if spot is not None else spot_many(spark, d)], [date_only(spark, d)], keys=KEYS, calendar="union")
    return fill(merged, FEATURES, KEYS)
