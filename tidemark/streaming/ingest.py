"""Landing-folder → snapshot table, exactly once per file."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def ingest_stream(spark: SparkSession, pattern: str, schema: T.StructType, out_dir: str,
                  checkpoint: str, fmt: str = "parquet") -> str:
    """Append every not-yet-seen file matching ``pattern`` to the Parquet
    table at ``out_dir`` and return its path. Runs as an ``availableNow``
    trigger: processes what has landed, then stops. The checkpoint (in the
    shared checkpoint folder) makes a rerun skip files already ingested. The
    table is written by the Parquet sink, which logs each micro-batch's files
    under the batch id and skips a batch that it has logged: a batch replayed
    after a crash adds nothing, and readers see logged files only."""
    src = spark.readStream.schema(schema).format(fmt).load(pattern)
    q = (src.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir
