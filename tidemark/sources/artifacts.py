"""Persisted artifacts as tables (Parquet): feature order, window datasets,
scaler parameters, model weights. Nothing is pickled or passed through the
driver; each artifact is a small or partitioned table."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scan import read_table, write_table

FEATURE_ORDER_SCHEMA = T.StructType([T.StructField("pos", T.IntegerType(), False),
                                     T.StructField("driver", T.StringType(), False)])


def feature_order(frame: DataFrame, exclude: Sequence[str] = ("ssd",)) -> DataFrame:
    """``(pos, driver)`` of every frame column except the keys, in frame
    order (the order a window row is laid out in)."""
    cols = [c for c in frame.columns if c not in set(exclude)]
    spark = frame.sparkSession
    return spark.createDataFrame([(i, c) for i, c in enumerate(cols)], FEATURE_ORDER_SCHEMA)


def save_windows(samples: DataFrame, path: str) -> None:
    """Window dataset ``(keys…, ssd, x, y, is_train)`` partitioned by split."""
    write_table(samples, path, partition_by=["is_train"])


def load_windows(spark: SparkSession, path: str, train_only: bool = False) -> DataFrame:
    """Read a window dataset; ``train_only`` reads just the ``is_train=true``
    folder (partition pruning). Folder values come back as text and are
    cast to BOOLEAN."""
    df = read_table(spark, path)
    if train_only:
        df = df.where(F.col("is_train").cast("string") == F.lit("true"))
    return df.withColumn("is_train", F.col("is_train").cast("string") == F.lit("true"))


def save_params(params: DataFrame, path: str) -> None:
    write_table(params, path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def save_models(models: DataFrame, path: str) -> None:
    """One row per (keys…, days_ahead): weights and input shape."""
    write_table(models, path, partition_by=["days_ahead"])


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Models ordered numerically by horizon (never by file name)."""
    df = read_table(spark, path)
    return df.withColumn("days_ahead", F.col("days_ahead").cast("int"))


def check_model_shape(models: DataFrame, dim: int) -> DataFrame:
    """Fail the job when a stored model was trained on windows of another
    size (``dim`` = lag × drivers); an empty model set is an error too."""
    bad = (F.col("dim") != F.lit(dim)) | (F.size("weights") != F.lit(dim))
    some = models.agg(F.count(F.lit(1)).alias("_n")).select(
        F.when(F.col("_n") == 0, F.raise_error(F.lit("no model in the set"))).otherwise(F.lit(1)).cast("int").alias("_some"))
    models = F.broadcast(some).join(models, F.col("_some") == 1, "left").drop("_some")
    return models.withColumn("weights", F.when(bad, F.raise_error(F.concat(
        F.lit("model input size "), F.col("dim").cast("string"), F.lit(f" does not match windows ({dim})"))))
        .otherwise(F.col("weights")))


def save_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table bucketed and sorted by its series, so that jobs which join such
    tables on the series read them without a shuffle. ``table`` is its name in the
    session's catalog, ``path`` the shared folder that holds its files."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    # one task per bucket: a bucket is one file, and its sort order can be used
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).format("parquet").saveAsTable(table))


def load_bucketed(spark: SparkSession, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table, registered anew if this session does not know it."""
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        cols = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({cols}) SORTED BY ({cols}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
