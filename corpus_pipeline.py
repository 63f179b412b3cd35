"""Corpus pipeline: five stages from raw documents to token ids. Each stage reads
what the stage before wrote as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, linededup, pieces, simhash
from tidemark.llm.common import materialize, scratch_path, table
from tidemark.llm.queries import THRESHOLD, toxicity_model


#: The key of a row of a stage's input; ids may be null or repeat.
ROW = "row_key"


def with_rows(docs: DataFrame) -> DataFrame:
    """The rows with a key each, written once so that it stays the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold of the toxicity query; the model
    learns from the labelled documents of the input. Each row is judged by its
    own text, whatever its id."""
    rows = with_rows(docs)
    scores = toxicity_model(spark, rows, sf_dir).score(rows, id_col=ROW)
    bad = materialize(scores.where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias(ROW)), "toxic")
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; a document that
    lost all its lines goes, one that had no text stays. ``n_chars`` follows."""
    out = linededup.dedup_lines(docs)
    return (out.where("n_dropped = 0 or n_dropped < n_lines")
            .withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest id, a null id last. Texts
    without words share fingerprint zero and are a group like any other."""
    rows = with_rows(docs)
    groups = simhash.simhash_groups(rows, shingle=3, max_bits=2, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = (groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("m")))
    later = materialize(groups.join(first.select(f"m.{ROW}"), ROW, "left_anti").select(ROW), "later")
    return rows.join(later, ROW, "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their id."""
    return decontam.without_leaks(with_rows(docs), table(spark, sf_dir, "benchmark"), doc_col=ROW).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_ids, round_trip)`` of every document."""
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("simhash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_benchmark), ("sentencepiece", tokens)]

#: The learned model, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder
    and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
