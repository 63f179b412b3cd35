"""Source scans (project → rename → cast → de-duplicate) and table I/O.

Scans take a DataFrame so the caller decides where rows come from (Parquet
in production, a view in tests). Only the named columns are selected, so
Parquet reads prune to them and date predicates downstream are pushed to
the file scan.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.casts import is_bad_real, nan_to_null, to_day, to_real
from tidemark.operators.profile import StageCounts


def _expr(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dtype(src: DataFrame, c) -> T.DataType:
    return src.select(_expr(c)).schema[0].dataType


def _real(src: DataFrame, c, cast: str) -> Column:
    """Numeric columns pass through (NaN → NULL); text uses ``to_real``."""
    if isinstance(_dtype(src, c), T.StringType):
        return to_real(_expr(c), cast)
    return nan_to_null(_expr(c).cast("double"))


def _bad(src: DataFrame, c, cast: str) -> Column:
    """A value that the cast cannot read: text without a number, or NaN."""
    return is_bad_real(_expr(c), cast) if isinstance(_dtype(src, c), T.StringType) else F.isnan(_expr(c).cast("double"))


def _day(src: DataFrame, c) -> Column:
    return to_day(_expr(c), _dtype(src, c))


def scan_prices(src: DataFrame, date_col, value_col, keys: Iterable[str] = (),
                out: str = "price", cast: str = "prefix", dedupe: str = "mean",
                counts: StageCounts | None = None, stage: str = "scan") -> DataFrame:
    """Daily price series ``(keys…, ssd DATE, <out> DOUBLE)``.

    Rows with an unreadable date are dropped. ``dedupe="mean"`` averages
    duplicate dates (a partial aggregate runs before the shuffle, so a hot
    key only ships one row per date and map task); ``"none"`` keeps them.
    With ``counts`` the scan notes under ``stage`` its rows, the dates missing and
    unreadable and the values that are no numbers.
    """
    keys = list(keys)
    df = src.select(*[F.col(k) for k in keys],
                    _day(src, date_col).alias("ssd"),
                    _real(src, value_col, cast).alias(out),
                    *([_expr(date_col).isNull().alias("_no_date"), _bad(src, value_col, cast).alias("_bad")] if counts else []))
    if counts:
        df = counts.watch(df, stage, null_dates=F.count(F.when(F.col("_no_date"), 1)),
                          bad_dates=F.count(F.when(F.col("ssd").isNull() & ~F.col("_no_date"), 1)),
                          bad_values=F.count(F.when(F.col("_bad"), 1))).drop("_no_date", "_bad")
    df = df.where(F.col("ssd").isNotNull())
    if dedupe == "mean":
        return df.groupBy(*keys, "ssd").agg(F.avg(out).alias(out))
    if dedupe == "none":
        return df
    raise ValueError(f"unknown dedupe {dedupe!r}")


def scan_series(src: DataFrame, date_col, value_col, out: str, keys: Iterable[str] = (),
                cast: str = "prefix", dedupe: str = "mean") -> DataFrame:
    """Any single daily driver (inventory, freight index …)."""
    return scan_prices(src, date_col, value_col, keys=keys, out=out, cast=cast, dedupe=dedupe)


def scan_long_index(src: DataFrame, date_col, driver_col, value_col,
                    exclude: Iterable[str] = (), cast: str = "prefix") -> DataFrame:
    """Long (entity-attribute-value) index table ``(ssd, driver, value)``.

    Excluded drivers are filtered with ``<>``, which also drops NULL drivers;
    the predicate reaches the Parquet scan when ``driver_col`` is a column.
    """
    exclude = list(exclude)
    df = src.select(_day(src, date_col).alias("ssd"),
                    _expr(driver_col).cast("string").alias("driver"),
                    _real(src, value_col, cast).alias("value"))
    cond = F.col("ssd").isNotNull() & F.col("driver").isNotNull()
    for x in exclude:
        cond = cond & (F.col("driver") != F.lit(x))
    return df.where(cond)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a stored table. CSV always with an explicit schema, header row,
    permissive mode (malformed fields become NULL)."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV tables are read with an explicit schema")
        return (spark.read.schema(schema).option("header", True)
                .option("mode", "PERMISSIVE").option("dateFormat", "yyyy-MM-dd").csv(path))
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Iterable[str] = ()) -> None:
    """Overwrite a table (one copy). Parquet by default; CSV with header."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        w.format(fmt).save(path)
