"""Forced refresh of a snapshot of landed tables. A refresh writes a version folder
of its own and then one row into the table's log; readers follow the log's newest
row. What fails in between leaves the old version in place, and a reader that has
planned on a version keeps it."""

from __future__ import annotations

import uuid
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "number long, version string"


def _log(spark: SparkSession, out_dir: str, table: str) -> DataFrame | None:
    """The commits of a table, or None before the first."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{out_dir.rstrip('/')}/{table}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, out_dir: str, table: str) -> tuple[int, str] | None:
    """Number and folder of the version committed last (of two refreshes that ran
    at once and took the same number, the larger version name)."""
    log = _log(spark, out_dir, table)
    row = None if log is None else log.selectExpr("max(struct(number, version)) AS m").first()["m"]
    return None if row is None else (row["number"], f"{out_dir.rstrip('/')}/{table}/{row['version']}")


def _commit(spark: SparkSession, out_dir: str, table: str, version: str) -> None:
    last = newest(spark, out_dir, table)
    row = [((last[0] if last else 0) + 1, version)]
    spark.createDataFrame(row, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{out_dir.rstrip('/')}/{table}/log")


def ingest_snapshot(spark: SparkSession, landing_dir: str, out_dir: str,
                    tables: Iterable[str], fmt: str = "parquet") -> dict[str, str]:
    """Every landed table is read and written as a new version, which then becomes the
    current one. Returns ``{table: folder of the version}``. Older versions stay until
    they are removed."""
    tables = list(tables)
    if not tables or any(not t for t in tables):
        raise ValueError("snapshot needs non-empty table names")
    out = {}
    for t in tables:
        version = f"v-{uuid.uuid4().hex}"
        out[t] = f"{out_dir.rstrip('/')}/{t}/{version}"
        spark.read.format(fmt).load(f"{landing_dir.rstrip('/')}/{t}.{fmt}").write.parquet(out[t])
        _commit(spark, out_dir, t, version)
    return out


def read_snapshot(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """The version of a table committed last."""
    found = newest(spark, out_dir, table)
    if found is None:
        raise FileNotFoundError(f"no committed version of {table} in {out_dir}")
    return spark.read.parquet(found[1])
