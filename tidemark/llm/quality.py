"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, materialize, text_bytes

FEATURES = ["bytes", "words", "mean_word", "distinct_words", "top_word", "short_words", "long_words", "lines", "mean_line",
            "repeated_lines", "short_lines", "ended_lines", "upper", "digits", "spaces", "high_bytes", "pipes", "marks",
            "stops", "commas", "symbols", "entropy", "bare_words", "repeated_pairs", "top_byte"]
_AT = {name: np.frombuffer(chars, np.uint8) for name, chars in (
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digits", b"0123456789"), ("spaces", b" \t\n\r"), ("pipes", b"|"), ("marks", b"!?"),
    ("stops", b"."), ("commas", b",;:"), ("symbols", b"#$%&*+<=>@[]^_`{}~\\/"))}


def statistics(data: bytes) -> list[float]:
    """Statistics of one text (UTF-8 bytes), in the order of ``FEATURES``; all
    zero for an empty text."""
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = byte[byte > 0] / n
    words, lines = data.split(), data.split(b"\n")
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    tally, pairs = Counter(words), len(set(zip(words, words[1:])))
    part = {k: float(byte[at].sum()) / n for k, at in _AT.items()}
    full = [x for x in lines if x.strip()]
    f = max(1, len(full))
    return [
        np.log1p(n), np.log1p(len(words)), float(lens.sum()) / m, len(tally) / m, max(tally.values(), default=0) / m,
        float((lens <= 3).sum()) / m, float((lens >= 12).sum()) / m, np.log1p(len(lines)), np.log1p(n / f),
        1 - len(set(full)) / f, sum(len(x) < 30 for x in full) / f, sum(x.rstrip()[-1:] in b".!?" for x in full) / f,
        part["upper"], part["digits"], part["spaces"], float(byte[128:].sum()) / n, part["pipes"], part["marks"], part["stops"],
        part["commas"], part["symbols"], float(-(share * np.log2(share)).sum()), sum(map(bytes.isalpha, words)) / m,
        1 - pairs / max(1, len(words) - 1), float(byte.max()) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<double>)`` for every row, over the whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], schema.field(1).type)],
                                             schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)), run, "doc_id long, x array<double>")


class BoostedTrees:
    """Trees of one fixed depth as flat arrays: node ``i`` of a tree has children
    ``2i + 1`` and ``2i + 2``; ``feature`` and ``threshold`` hold the inner nodes
    of all trees row by row, ``value`` the leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, one level a step."""
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        while inner and len(self.feature) and at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        total = self.base + (self.value[trees, at - inner].sum(axis=1) if len(self.feature) else np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.15,
            ridge: float = 2.0, least: float = 1.0) -> BoostedTrees:
        """Logistic loss; per level, gradient and curvature histograms of all
        (node, feature, bin) cells come from two counting passes."""
        n, m = x.shape
        base = float(np.log((y.sum() + .5) / (n - y.sum() + .5)))
        inner = (1 << depth) - 1
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
        value, total = np.zeros((trees, inner + 1)), np.full(n, base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            at, first = np.zeros(n, np.int64), 0
            for level in range(depth):
                nodes = 1 << level
                cell = (((at - first)[:, None] * m + np.arange(m)) * bins + binned).ravel()
                shape = (nodes, m, bins)
                gs = np.bincount(cell, np.repeat(g, m), nodes * m * bins).reshape(shape).cumsum(axis=2)
                hs = np.bincount(cell, np.repeat(h, m), nodes * m * bins).reshape(shape).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                for j, c in enumerate(cuts):
                    gain[:, j, len(c):] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
                f, b = best // bins, best % bins
                feature[t, first:first + nodes] = np.where(good, f, 0)
                threshold[t, first:first + nodes] = [cuts[j][k] if ok else np.inf for j, k, ok in zip(f, b, good)]
                node = at - first
                right = good[node] & (binned[np.arange(n), f[node]] > b[node])
                at, first = 2 * at + 1 + right, first + nodes
            leaf = at - inner
            value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            total += value[t][leaf]
        return cls(feature, threshold, value, base)


def fit_quality(stats: DataFrame, labelled: DataFrame, max_rows: int = 20_000, **kw) -> BoostedTrees:
    """Trees from ``labelled(doc_id, y)`` (``y`` 0 or 1, others left out) and
    their statistics. ``max_rows`` bounds the labels taken (smallest hashes of the
    id, chosen before the join). Without both classes the model is the base
    rate."""
    chosen = materialize(labelled.where("y in (0, 1)").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
                         .orderBy("h", "y").limit(max_rows), "chosen")
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy("h", "y", "x").select("x", "y").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        empty = np.zeros((0, 0), np.int64)
        return BoostedTrees(empty, empty.astype(float), np.zeros((0, 1)), float(np.log((y.sum() + .5) / (len(y) - y.sum() + .5))))
    return BoostedTrees.fit(x, y, **kw)


def score_quality(stats: DataFrame, model: BoostedTrees) -> DataFrame:
    """``(doc_id, score)``: probability of quality 1."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(x))], schema=schema)

    return arrow_map(stats.select("doc_id", "x"), run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labelled: DataFrame, max_rows: int = 20_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``: statistics are computed and
    written once, a bounded labelled sample fits the trees, all rows are scored.

    Null and empty texts have zero statistics and get a score like any row; rows
    with a null id are scored but never learned from; repeated ids give a row
    each. Other columns are not read; an empty table gives an empty result."""
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    return score_quality(stats, fit_quality(stats, labelled, max_rows))
