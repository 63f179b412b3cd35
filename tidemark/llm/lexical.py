"""Ranked lexical search: item weights times document impacts as dense blocks in
exact float64 arithmetic, and a top-k that is safe for ties."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches_of, materialize, text_bytes

#: Items of one tile, vocabulary columns of one block of the multiplication.
TILE_ITEMS, BLOCK_TERMS = 256, 4096
#: (item, term) rows that are broadcast at once; more items go through in rounds.
ROUND_TERMS = 1_000_000
#: Parts that a top-k is merged in before the last merge.
MERGE_PARTS = 64
EXACT = 1 << 53
TOP_IMPACT = 1_000_000  # an impact is always below this

#: Bytes that belong to no term become spaces, A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters of UTF-8 bytes, with only
    A-Z lower-cased."""
    return data.translate(FOLD).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, term)``, each once; texts that share an id are one item."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary())])

    def rows(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in set(terms_of(text)):
                    yield item, t

    src = items.select(F.col(id_col).cast("long").alias("item"), text_bytes(text_col).alias("text"))
    return materialize(arrow_map(src, lambda x: batches_of(rows(x), schema), "item long, term binary").distinct(), "item-terms")


def in_rounds(terms: DataFrame, most: int) -> list[DataFrame]:
    """The items in rounds of at most ``most`` rows (or of one item)."""
    n, rounds = terms.count(), 1
    if n > most:
        rounds = 2 * -(-n // most)
    while rounds > 1:
        of = F.pmod(F.xxhash64("item"), F.lit(rounds))
        worst = (terms.groupBy(of.alias("r"), "item").agg(F.count(F.lit(1)).alias("n")).groupBy("r")
                 .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where(F.col("n") > most).where("k > 1"))
        if worst.isEmpty():
            break
        rounds *= 2
    return [terms] if rounds == 1 else [terms.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r) for r in range(rounds)]


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, cols, tfs)`` of every row: its number of terms and, for those of
    the vocabulary, column and frequency."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cols", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        column = known.value
        for b in batches:
            sizes, offsets, cols, tfs = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                held = Counter(c for c in map(column.get, words) if c is not None)
                cols.extend(held.keys())
                tfs.extend(held.values())
                offsets.append(len(cols))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(cols, pa.int32())),
                                              pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return materialize(arrow_map(src, run, "doc_id long, n long, cols array<int>, tfs array<int>"), "term-counts")


class Tile:
    """Some items with a compact vocabulary of their own, in blocks of columns
    narrow enough that no partial sum reaches 2^53."""

    def __init__(self, items: np.ndarray, cols: np.ndarray, weights: np.ndarray, first: int, count: int, n_cols: int):
        inside = (items >= first) & (items < first + count) & (weights[cols] > 0)
        row, used = items[inside] - first, cols[inside]
        self.first, self.count, (self.cols, local) = first, count, np.unique(used, return_inverse=True)
        self.local = np.full(n_cols, -1, np.int32)
        self.local[self.cols] = np.arange(len(self.cols))
        width = max(1, min(BLOCK_TERMS, (EXACT - 1) // (int(weights.max(initial=1)) * TOP_IMPACT)))
        self.blocks = []
        for start in range(0, len(self.cols), width):
            end = min(start + width, len(self.cols))
            here = (local >= start) & (local < end)
            rows, r = np.unique(row[here], return_inverse=True)  # items without a term of the block take no part
            w = np.zeros((len(rows), end - start))
            w[r, local[here] - start] = weights[used[here]]
            self.blocks.append((start, end, rows, w))

    def scores(self, docs: np.ndarray, cols: np.ndarray, impacts: np.ndarray, n_docs: int) -> np.ndarray:
        """Whole-number scores, items by documents."""
        out = np.zeros((self.count, n_docs), np.int64)
        at = self.local[cols]
        for start, end, rows, w in self.blocks:
            here = (at >= start) & (at < end)
            dense = np.zeros((end - start, n_docs))
            dense[at[here] - start, docs[here]] = impacts[here]
            out[rows] += (w @ dense).astype(np.int64)
        return out


class Best:
    """The k best documents of each item so far: by score, then by id (null ids
    last). What can't be among them is turned away before it is kept."""

    def __init__(self, n_items: int, k: int):
        self.k, self.n = k, n_items
        self.kept = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0, bool)]  # item, score, id, id is null
        self.least = np.ones(n_items, np.int64)  # scores below are out
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[first:first + len(scores), None])  # ties stay
        if len(item):
            self.new.append((item + first, scores[item, doc], ids[doc], null[doc]))
            self.waiting += len(item)
            if self.waiting > 20 * self.k * self.n + 10_000:
                self.settle()

    def settle(self) -> None:
        item, score, ids, null = (np.concatenate([x, *(n[i] for n in self.new)]) for i, x in enumerate(self.kept))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        last = order[rank == self.k - 1]
        items = np.concatenate([self.kept[0], *(n[0] for n in self.new)])
        self.least[items[last]] = score[last]
        self.kept = [items[keep], score[keep], ids[keep], null[keep]]
        self.new, self.waiting = [], 0


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _round(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Search of one round of items: ``(item_id, doc_id, score)``, the best k of
    every task."""
    spark = docs.sparkSession
    pairs = terms.collect()  # at most ROUND_TERMS rows
    names = sorted({r["term"] for r in pairs})
    vocabulary = {bytes(t): c for c, t in enumerate(names)}
    item_ids = sorted({r["item"] for r in pairs}, key=lambda x: (x is None, x or 0))
    number = {x: i for i, x in enumerate(item_ids)}
    counts = term_counts(docs, vocabulary, id_col, text_col)
    total = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    weights = np.zeros(len(names), np.int64)
    for r in counts.select(F.explode("cols").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df")).collect():  # of the vocabulary only
        weights[r["c"]] = weight(n_docs, r["df"])
    order = np.argsort(items := np.array([number[r["item"]] for r in pairs], np.int64), kind="stable")
    sent = spark.sparkContext.broadcast((items[order], np.array([vocabulary[bytes(r["term"])] for r in pairs], np.int64)[order], weights, item_ids))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        items, cols, weights, names = sent.value
        tiles = [Tile(items, cols, weights, i, min(TILE_ITEMS, len(names) - i), len(weights)) for i in range(0, len(names), TILE_ITEMS)]
        best = Best(len(names), k)
        for b in batches:
            b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column("cols")), 0))
            if not b.num_rows:
                continue
            null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = b.column("doc_id").fill_null(0).to_numpy()
            at = np.repeat(np.arange(b.num_rows), b.column("cols").value_lengths().to_numpy())
            col, tf = b.column("cols").flatten().to_numpy(), b.column("tfs").flatten().to_numpy().astype(np.int64)
            m = np.array([50 + 50 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            impacts = impact(tf, m[at])
            for t in tiles:
                best.add(t.first, t.scores(at, col, impacts, b.num_rows), ids, null)
        best.settle()
        item, score, ids, null = best.kept
        yield from batches_of(zip([names[i] for i in item.tolist()], [None if x else i for i, x in zip(ids.tolist(), null.tolist())], score.tolist()), schema)

    return arrow_map(counts, run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", round_terms: int = ROUND_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item
    among all rows of ``docs`` with a score above 0, equal scores by ascending id.

    Term counts of the documents are taken for the items' vocabulary only and
    written once; document frequencies are summed from them. Each task multiplies
    tiles of items with batches of documents and keeps k documents an item; these
    meet in ``MERGE_PARTS`` merges an item and a last one.

    Every row is a document, also one whose id repeats or is null (null ids come
    last among equal scores). Null and empty texts have no terms and are in no
    count but that of rows. Texts that share an item id are one item. Items without
    terms and an empty table give no rows. Very long texts are read whole; invalid
    UTF-8 is read as bytes. Other columns are not read.
    """
    from pyspark.sql import Window

    found = None
    for part in in_rounds(item_terms(items, item_col, item_text_col), round_terms):
        got = _round(docs, part, k, id_col, text_col)
        found = got if found is None else found.union(got)

    def best(df, *by):
        w = Window.partitionBy("item_id", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    some = best(found.withColumn("piece", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))), "piece").drop("rank", "piece")
    return best(some).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
