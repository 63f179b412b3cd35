"""Filter interaction audit: what each filter removes alone, after others and in
every order, from sorted lists of failing ids."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches_of, materialize, text_bytes

#: Ids of one range: a group of posting lists covers at most this many rows.
RANGE_BITS = 16
#: A text that more than this share of all rows repeat is joined by broadcast; there
#: are at most 1 / HOT_SHARE such texts.
HOT_SHARE = 0.001

UPPER = bytes(range(0x41, 0x5B))
TRAILING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
SIGNS = b"#$%&*|"
NAMES = "ABCDE"


def failures(data: bytes) -> int:
    """Bits 0 to 3 of a text's UTF-8 bytes: fewer than 50 words; fewer than 65 in
    100 words distinct; over 5 in 100 code points A-Z; holds one of ``SIGNS``."""
    words = data.split()  # ASCII white space
    few = len(words) < 50
    same = 100 * len(set(words)) < 65 * len(words)
    upper = 100 * (len(data) - len(data.translate(None, UPPER))) > 5 * len(data.translate(None, TRAILING))
    signs = len(data.translate(None, SIGNS)) < len(data)
    return few | same << 1 | upper << 2 | signs << 3


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(row, part, doc_id, fails, digest)`` for every row: an own key, the part
    (null: empty string), the bits of ``failures`` and the text's SHA-256. Written
    once, as the keys must stay the same."""
    schema = pa.schema([("row", pa.int64()), ("part", pa.string()), ("doc_id", pa.int64()), ("fails", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            texts = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([failures(t) for t in texts], pa.int32()),
                                              pa.array([sha256(t).digest() for t in texts], pa.binary())], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return materialize(arrow_map(rows, run, "row long, part string, doc_id long, fails int, digest binary"), "assessed")


def later_copies(rows: DataFrame) -> DataFrame:
    """``(row, part)`` of the rows whose text a smaller ``doc_id`` holds as well,
    in whatever part. A text with many copies is one row of the right side, and
    the few that hold a large share of the table are not shuffled by text."""
    groups = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    often = F.col("n") > rows.count() * HOT_SHARE
    hot, rest = groups.where(often), groups.where(~often)
    held = F.broadcast(hot.select("digest", "first"))
    later = [rows.join(held, "digest"), rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")]
    return later[0].where("doc_id > first").select("row", "part").union(later[1].where("doc_id > first").select("row", "part"))


def _gallop(ids: Sequence[int], at: int, stop: int) -> int:
    """First position from ``at`` on whose id is ``stop`` or more: strides that
    double, then a binary search inside the last."""
    step = 1
    while at + step < len(ids) and ids[at + step] < stop:
        step *= 2
    return bisect_left(ids, stop, at + step // 2, min(at + step, len(ids)))


def cells(lists: Sequence[Sequence[int]]) -> Counter:
    """A k-way merge of sorted lists of distinct ids: for each set of lists (bit i:
    list i) the number of ids that are in all of them and in no other. A run of
    ids that one list alone holds is passed in one galloping step."""
    count: Counter = Counter()
    at = [0] * len(lists)
    live = [i for i, ids in enumerate(lists) if len(ids)]
    while live:
        heads = [lists[i][at[i]] for i in live]
        low = min(heads)
        holders = [i for i, v in zip(live, heads) if v == low]
        if len(holders) == 1:
            i = holders[0]
            others = [v for v in heads if v != low]
            end = _gallop(lists[i], at[i], min(others)) if others else len(lists[i])
            count[1 << i] += end - at[i]
            at[i] = end
        else:
            count[sum(1 << i for i in holders)] += 1
            for i in holders:
                at[i] += 1
        live = [i for i in live if at[i] < len(lists[i])]
    return count


def part_cells(postings: DataFrame, n_lists: int) -> DataFrame:
    """``(part, mask, n)`` from postings ``(row, part, list)``: per part and range of
    ids the sorted lists are merged, the sizes of the ranges are summed. A range
    bounds a group, so a part with most of all rows is many groups."""
    ranged = postings.groupBy("part", F.shiftright("row", RANGE_BITS).alias("range")).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("list") == i, F.col("row")))).alias(f"l{i}") for i in range(n_lists)])
    schema = pa.schema([("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

    def rows(batches) -> Iterator[tuple]:
        for b in batches:
            for part, *lists in zip(*(c.to_pylist() for c in b.columns)):
                for mask, n in cells(lists).items():
                    yield part, mask, n

    found = arrow_map(ranged.drop("range"), lambda x: batches_of(rows(x), schema), "part string, mask int, n long")
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"))


def measures(n_filters: int, n_marks: int) -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """The steps ``(order, step, filter)`` of every order of the filters and, for
    each measure, a matrix of steps by masks: which cells count."""
    steps, filters, before = [], [], []
    for order in permutations(range(n_filters)):
        done = 0
        for k, f in enumerate(order):
            steps.append(("".join(NAMES[i] for i in order), k + 1, f))
            filters.append(1 << f)
            before.append(done)
            done |= 1 << f
    mask = np.arange(1 << n_filters + n_marks)
    own, prior = np.array(filters)[:, None], np.array(before)[:, None]
    fails, gone = (mask & own) != 0, (mask & prior) != 0
    alone = (mask & (1 << n_filters) - 1) == own
    out = {"out": fails | gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": alone}
    for k in range(n_marks):
        out[f"lost{k}"] = fails & ~gone & ((mask >> n_filters + k & 1) == 1)
    return steps, {k: v.astype(np.int64) for k, v in out.items()}


def audit_orders(totals: DataFrame, sizes: DataFrame, n_filters: int = 5, marks: Sequence[str] = ("good_lost", "toxic_lost")) -> DataFrame:
    """One row per part of ``totals(part, n_rows)``, order of the filters and step,
    from the cells ``sizes(part, mask, n)``: differences and unions of the failing
    ids are sums of cells."""
    fields = ["kept", "removed", "redundant", "unique_fails", *marks, "shapley"]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(f, pa.int64()) for f in fields]])
    listed = sizes.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("cells"))  # as many as masks at most
    parts = totals.join(listed, "part", "left").select("part", "n_rows", "cells")

    def run(batches):
        steps, use = measures(n_filters, len(marks))
        at = np.array([f for _, _, f in steps])
        orders, ks = pa.array([o for o, _, _ in steps]), pa.array([k for _, k, _ in steps], pa.int32())
        for b in batches:
            for part, n, found in zip(*(c.to_pylist() for c in b.columns)):
                size = np.zeros(1 << n_filters + len(marks), np.int64)
                for c in found or []:
                    size[c["mask"]] = c["n"]
                got = {k: m @ size for k, m in use.items()}
                shapley = np.zeros(n_filters, np.int64)
                np.add.at(shapley, at, got["removed"])
                cols = [n - got["out"], got["removed"], got["redundant"], got["unique_fails"],
                        *[got[f"lost{k}"] for k in range(len(marks))], shapley[at]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), orders, ks, *map(pa.array, cols)], schema=schema)

    return arrow_map(parts, run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in fields))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters (``failures`` and, as E, ``later_copies``) over every row of
    ``docs``, in all 120 orders, per part: ``(part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.
    ``labels(doc_id, quality, toxic)`` marks good and toxic documents; several
    labels of an id count once each way.

    Every row is a document of its own, also one whose id repeats or is null (a
    null id is neither smaller than another nor labelled). Null texts count as
    empty; an empty text fails A, and E beside an earlier empty one. Invalid UTF-8
    is read as bytes. Very long texts are read whole, one at a time. Ties in the id
    are no smaller ids. An empty table gives no rows. Other columns are not read.
    """
    rows = assess(docs, id_col, text_col, part_col)
    lists = [rows.where(F.col("fails").bitwiseAND(1 << i) != 0).select("row", "part", F.lit(i).alias("list")) for i in range(4)]
    lists.append(later_copies(rows).select("row", "part", F.lit(4).alias("list")))
    for i, mark in ((5, "quality"), (6, "toxic")):
        marked = labels.where(F.col(mark) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        lists.append(rows.select("row", "part", "doc_id").join(marked, "doc_id").select("row", "part", F.lit(i).alias("list")))
    postings = lists[0]
    for x in lists[1:]:
        postings = postings.union(x)
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    return audit_orders(totals, part_cells(postings, 7))
