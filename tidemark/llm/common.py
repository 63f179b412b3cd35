"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path, ship_package

__all__ = ["materialize", "scratch_path", "table", "arrow_map", "batches_of", "small_batches", "text_bytes", "valid_text", "Generations"]

#: What goes to a Python task at once: rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes, null as empty: Python tasks then skip one
    decoding of every document."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def valid_text(col: str = "text"):
    """The text, null as empty; what is no UTF-8 in it becomes U+FFFD."""
    return F.make_valid_utf8(F.coalesce(F.col(col), F.lit("")))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the executors. The session's
    Arrow batches are set to at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes,
    and ``fn`` meets no more text than that at once (but for a longer single
    text), so a run of long documents does not fill a task's memory."""
    spark = df.sparkSession
    ship_package(spark)
    held = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(lambda batches: fn(small_batches(batches)), schema)


def small_batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut (without a copy) where their texts pass ``most`` bytes."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1)).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield b.slice(start, end - start)


class Generations:
    """A table that stays bounded: when the young generation holds more than ``most``
    keys it becomes the old one, whose keys are taken over as they are met again.
    Read from ``young`` after ``unknown`` was asked for the same keys."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def unknown(self, keys: set) -> set:
        """The keys of neither generation; the others are in ``young`` now."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        keys = keys.difference(self.young)
        again = [k for k in keys if k in self.old] if self.old else []
        self.young.update((k, self.old.pop(k)) for k in again)
        return keys.difference(again)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
