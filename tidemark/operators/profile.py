"""Row and shape profiles: counts per stage of a job, and of the label table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_SCHEMA = T.StructType([
    T.StructField("ssd", T.DateType()),
    T.StructField("current_spot_price", T.DoubleType()),
    T.StructField("predicted_for", T.DateType()),
    T.StructField("days_ahead", T.IntegerType()),
    T.StructField("y", T.DoubleType()),
])


class StageCounts:
    """Counts of a job's stages, gathered by the job that computes them
    (``DataFrame.observe``), not by jobs of their own. Each watched frame must feed
    one written table; a task that runs again after a failure may count twice."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df``, observed: its rows and the named aggregates."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        self._seen.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """``(stage, metric, n)``; waits for the jobs that write the watched frames."""
        rows = [(stage, k, int(v)) for stage, seen in self._seen for k, v in seen.get.items()]
        return spark.createDataFrame(rows, "stage string, metric string, n long")


def profile_labels(labels: DataFrame) -> DataFrame:
    """First label date, distinct dates, rows, rows with a target."""
    return labels.agg(F.min("ssd").alias("first_ssd"),
                      F.count_distinct("ssd").alias("n_dates"),
                      F.count(F.lit(1)).alias("n_rows"),
                      F.count("y").alias("n_labelled"))
