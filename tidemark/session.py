"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates, adaptive execution (runtime
# coalescing, skew-join splitting, broadcast conversion from measured sizes)
# and Arrow for the few Python stages.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Joins on (series_id, ssd) may reuse a series_id partitioning that the
    # per-series window stages already produced (no second shuffle).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(master: str | None = None, app: str = "tidemark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    On a cluster leave ``master`` empty and let spark-submit decide; tests
    pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names this folder (on shared storage) and must do so: without it a
    job on any master but ``local[…]`` stops here. Only a local session gets a
    private scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage: write the frame as Parquet into the shared checkpoint
    folder and read it back.

    One job (a reliable ``checkpoint()`` without a cache computes its input
    twice), columnar and compressed, and the re-read frame carries file
    statistics that adaptive execution uses for join planning. A lost
    executor re-reads the files instead of recomputing the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name or 'frame'}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows that ``by_series`` puts in one partition: some eighty daily series, whose
#: windows, lag steps and scores a task then makes without a spill.
ROWS_PER_PART = 40_000


def by_series(df: DataFrame, keys: Iterable[str], parts: int | None = None) -> DataFrame:
    """The rows dealt by ``keys``, as many partitions as their number asks for (or
    ``parts``). Windows, aggregates and joins on these keys and any further ones then
    need no shuffle of their own, and what a row is widened or exploded to later is
    never sent. ``df`` should be a stored table: its rows are counted first."""
    # joins on these keys and further ones keep the deal, whatever session runs them
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(parts or series_parts(df), *keys)


def series_parts(df: DataFrame) -> int:
    """Partitions of ``by_series``: they grow with the rows, a partition does not."""
    return max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_PER_PART + 1)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidemark`` importable in executor Python workers (what
    ``--py-files`` does): the package is zipped once per SparkContext and
    added with ``addPyFile``, which distributes it to every executor.
    Called by the operators that run Python tasks."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="tidemark-pyfiles-"), "tidemark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, root)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
