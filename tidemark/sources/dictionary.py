"""Driver dictionary (name → business metadata) read from a JSON document."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PATH = os.path.join(os.path.dirname(__file__), "driver_dictionary.json")
INFO_FIELDS = ["business_name", "asset_class", "macro_role", "relationship_to_target"]
DICT_SCHEMA = "map<string, struct<" + ", ".join(f"{f}: string" for f in INFO_FIELDS) + ">>"


def driver_dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(driver, business_name, asset_class, macro_role, relationship_to_target)``
    from one JSON object keyed by driver. ``path`` is read by Spark from any store
    (whole, parsed in the JVM); without it the package's own document is taken,
    which lies beside the code and need not be on the cluster's file system."""
    if path is None:
        with open(DEFAULT_PATH, encoding="utf-8") as f:
            doc = spark.createDataFrame([(f.read(),)], "value string")
    else:
        doc = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), DICT_SCHEMA)
    return (doc.select(F.explode(m).alias("driver", "info"))
            .select("driver", *[F.col(f"info.{f}").alias(f) for f in INFO_FIELDS]))


def with_driver_info(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attach dictionary fields by ``driver``; an unknown driver fails the job
    (``raise_error``) instead of producing empty metadata. The dictionary is
    one row per driver of the frame (a few dozen), broadcast."""
    j = df.join(F.broadcast(dictionary), "driver", "left")
    checked = F.when(F.col("business_name").isNull(),
                     F.raise_error(F.concat(F.lit("unknown driver: "), F.col("driver").cast("string")))) \
        .otherwise(F.col("business_name"))
    return j.withColumn("business_name", checked)
