"""Benchmark decontamination: size-partitioned MinHash containment search, then
exact shingle containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches_of, materialize, text_bytes

BROADCAST_VALUES = 1_000_000


def shingle_hashes(data: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct 63-bit hashes of the word shingles of UTF-8 bytes, sorted; A-Z
    lower-cased, words cut at ASCII white space, fewer words than ``shingle``:
    the whole sequence, none: nothing."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e]) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)
    return np.unique((hashes >> np.uint64(1)).view(np.int64))


def item_sketches(items: DataFrame, shingle: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """``(item, part, n, value)``: an item's MinHash sketch. ``part`` is the size
    partition (the power of two at or below its ``n`` distinct shingles). The
    sketch holds the ``n - ceil(least * n) + 1`` smallest hashes: a document with
    ``least`` of the shingles lacks fewer than that, so it holds one of them."""
    schema = pa.schema([("item", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("value", pa.int64())])

    def rows(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingle_hashes(text, shingle)
                n = len(h)
                for v in h[:n - need(n, least) + 1].tolist() if n else []:
                    yield item, n.bit_length() - 1, n, v

    items = items.select(F.col(id_col).cast("long").alias("item"), text_bytes(text_col)).where("item is not null").distinct()
    return arrow_map(items, lambda x: batches_of(rows(x), schema), "item long, part int, n long, value long")


def need(n: int, least: float) -> int:
    """Shingles out of ``n`` that make a containment of ``least``."""
    return max(1, int(np.ceil(round(least * n, 9))))


def held_values(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sorted ``values`` of one size partition that are among the sorted
    ``hashes``; only hashes up to the partition's largest value are looked at."""
    h = hashes[:np.searchsorted(hashes, values[-1], "right")]
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    return h[values[at] == h]


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8,
                    doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for every document
    that holds at least ``least`` of an item's distinct word shingles.

    Candidates come from MinHash values. Items are partitioned by size, and a
    sketch holds the smallest hashes, as many as ``least`` asks for at that size.
    A document keeps its hashes up to the largest sketch value and joins the
    items on them, so no pair is missed at any size of document or item.
    Candidates are then verified on all shingles of both texts. With up to
    ``broadcast_values`` sketch values (counted first) the tasks screen their
    hashes against each partition's sorted values before the join; beyond it
    they shuffle the hashes and the join alone decides.

    Texts without words match nothing; rows with a null id are left out of the
    search; repeated (id, text) rows give one row per pair, and rows that share
    an id with different texts count together as a match if one of them matches,
    with the largest containment. Other columns are not read.
    """
    spark = docs.sparkSession
    sketch = materialize(item_sketches(items, shingle, least, item_col, item_text_col), "sketches")
    parts = [r["part"] for r in sketch.select("part").distinct().collect()]  # at most 63 size partitions
    top = sketch.agg(F.max("value")).first()[0] or -1
    probe = None
    if sketch.count() <= broadcast_values:
        values = {p: np.array([r[0] for r in sketch.where(F.col("part") == p).select("value").distinct().sort("value").collect()],
                              np.int64) for p in parts}
        probe = spark.sparkContext.broadcast(values)
    schema = pa.schema([("doc", pa.int64()), ("value", pa.int64())])

    def rows(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingle_hashes(text, shingle)
                h = h[:np.searchsorted(h, top, "right")]
                if probe is not None and len(h):
                    h = np.unique(np.concatenate([h[:0], *(held_values(h, x) for x in probe.value.values())]))
                for v in h.tolist():
                    yield doc, v

    doc_text = docs.select(F.col(doc_col).cast("long").alias("doc"), text_bytes(text_col).alias("body")).where("doc is not null")
    hits = arrow_map(doc_text, lambda x: batches_of(rows(x), schema, 16384), "doc long, value long")
    pairs = materialize(hits.join(sketch.select("item", "value"), "value").select("doc", "item").distinct(), "candidates")
    item_text = items.select(F.col(item_col).cast("long").alias("item"), text_bytes(item_text_col).alias("want"))
    # documents first cut down to candidates; an item's text is short beside them
    picked = (doc_text.join(pairs, "doc").join(item_text.where("item is not null"), "item")
              .select("doc", "item", "body", "want"))
    found = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])

    def verify(batches):
        last, have = None, None
        for b in batches:
            out = []
            for doc, item, body, want in zip(*(c.to_pylist() for c in b.columns)):
                if last is None or last != body:
                    last, have = body, shingle_hashes(body, shingle)
                w = shingle_hashes(want, shingle)
                n = len(np.intersect1d(w, have, assume_unique=True))
                if len(w) and n >= need(len(w), least):
                    out.append((doc, item, n, len(w)))
            yield from batches_of(iter(out), found)

    sure = arrow_map(picked, verify, "doc_id long, item_id long, n_shared long, n_item long")
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")


def without_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", **kw) -> DataFrame:
    """Rows of ``docs`` whose document holds no item; rows with a null id stay."""
    bad = contained_items(docs, items, doc_col=doc_col, **kw).select(F.col("doc_id").alias(doc_col)).distinct()
    bad = materialize(bad, "leaks")
    return docs.join(bad, doc_col, "left_anti").select(*docs.columns)
