"""Embedding near-duplicates: spherical-cap filters from structured random
product codes, joined on filters and verified by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, materialize
from tidemark.llm.components import connected_components

CHUNK = 1024
#: Vectors of fewer dimensions are all compared: near vectors share too few caps of so small an area there.
ALL_PAIRS = 12


#: A label of up to this many distinct vectors has codes of level 0; each level more is for four times as many.
LEVEL_ROWS = 8_000
#: Above this level filter numbers would pass 32 bits; labels of more than LEVEL_ROWS * 4 ** TOP_LEVEL vectors
#: (33 million) get no rarer filters, and their buckets grow with them again.
TOP_LEVEL = 6


def level_of(n: int) -> int:
    """The level whose filters hold about as many of ``n`` vectors as those of level
    0 hold of ``LEVEL_ROWS``."""
    level = 0
    while n > LEVEL_ROWS * 4 ** level and level < TOP_LEVEL:
        level += 1
    return level


def cap_areas(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles and the share of the sphere of ``dim`` dimensions within each of a direction."""
    # the angle has density sin(angle) ** (dim - 2)
    angle = np.linspace(0, np.pi, 200_001)
    with np.errstate(divide="ignore"):
        weight = np.exp((dim - 2) * np.log(np.sin(angle).clip(0))) if dim > 2 else np.ones_like(angle)
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return angle, area / area[-1]


def level_code(codes: int, words: int, tail: float, level: int, of: int = 64) -> tuple[int, float]:
    """``(words, tail)`` of a level: a filter takes a quarter of the vectors that one
    of the level before takes, and there are enough filters for a vector to have 4
    more than there (20 at level 0), since near vectors share a rarer filter less often."""
    if level == 0:
        return words, tail
    from statistics import NormalDist
    normal = NormalDist()
    tail = -normal.inv_cdf((1 - normal.cdf(tail)) / 4 ** level)
    angle, area = cap_areas(of)
    small = float(np.interp(np.arccos(min(1.0, tail / np.sqrt(of))), angle, area))
    return int(np.ceil(np.sqrt(19.5 * (1 + .22 * level) / (codes * small)))), tail


def cap_bound(dim: int, tail: float, of: int = 64) -> float:
    """The inner product at which a vector is sent to a filter. From ``of``
    dimensions on, ``tail`` standard deviations of that of random unit vectors. In
    fewer, where that many are rare, the bound that random vectors pass as often as
    in ``of``: the cap area, and with it the number of filters, stays the same."""
    if dim >= of:
        return float(tail / np.sqrt(dim))
    angle, area = cap_areas(of)
    want = np.interp(np.arccos(min(1.0, tail / np.sqrt(of))), angle, area)
    angle, area = cap_areas(dim)
    return float(np.cos(np.interp(want, area, angle)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in doubles; scaled first so that no square over- or
    underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class ProductCode:
    """``codes`` random product codes of ``words ** 2`` directions each: after a
    random rotation, a direction is a random word of the first half of the
    coordinates beside one of the second. ``decode`` lists every direction whose
    inner product with a unit vector is at least ``cap_bound``. A first word is looked at only where the best second word
    can lift it over the bound. Several small codes instead of one large one keep
    the number of filters of a vector near its mean."""

    def __init__(self, dim: int, codes: int = 12, words: int = 40, tail: float = 3.0, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        self.words, self.least, self.codes = words, cap_bound(dim, tail), []
        for _ in range(codes):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            both = []
            for part in np.array_split(turn, 2, axis=1):
                c = rng.standard_normal((words, part.shape[1]))
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                both.append(part @ c.T * np.sqrt(part.shape[1] / dim))  # scores are x @ this
            self.codes.append(both)

    def decode(self, x: np.ndarray, step: int = 2048) -> list[np.ndarray]:
        """The sorted filter numbers of each row of unit vectors ``x``."""
        out = []
        for at in range(0, len(x), step):
            rows, found = [], []
            for k, (one, two) in enumerate(self.codes):
                s, t = x[at:at + step] @ one, x[at:at + step] @ two
                row, first = np.nonzero(s >= self.least - t.max(axis=1, keepdims=True))
                pair, second = np.nonzero(t[row] >= (self.least - s[row, first])[:, None])
                rows.append(row[pair])
                found.append((k * self.words + first[pair]) * self.words + second)
            rows, found = np.concatenate(rows), np.concatenate(found).astype(np.int32)
            order = np.lexsort((found, rows))
            ends = np.searchsorted(rows[order], np.arange(1, len(x[at:at + step])))
            out += np.split(found[order], ends)
        return out


def bucket_links(x: np.ndarray, node: np.ndarray, copies: np.ndarray, lists: list, left: np.ndarray, right: np.ndarray,
                 filt: int, least: float) -> list[tuple[int, int, int]]:
    """``(node, links, root)`` of the members of one filter that have a verified
    partner among ``left`` x ``right`` (row numbers; equal for a bucket against
    itself). A pair counts in the first filter that it shares and nowhere else;
    ``root`` is the smallest node that links here reach."""
    same = left is right
    near = x[left] @ x[right].T >= least
    if same:
        np.fill_diagonal(near, False)
    li, ri = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(li):
        return []
    left, right, near = left[li], right[ri], near[np.ix_(li, ri)]
    mine, yours = ([[f for f in lists[i] if f < filt] for i in side] for side in (left, right))
    known = {f: k for k, f in enumerate({f for fs in mine for f in fs} & {f for fs in yours for f in fs})}
    count = near
    if known:
        a, b = np.zeros((len(left), len(known)), np.float32), np.zeros((len(right), len(known)), np.float32)
        for m, fs_all in ((a, mine), (b, yours)):
            for i, fs in enumerate(fs_all):
                m[i, [known[f] for f in fs if f in known]] = 1
        count = near & (a @ b.T == 0)
    links = dict.fromkeys(node[np.concatenate([left, right])].tolist(), 0)
    for n, k in zip(node[left].tolist(), (count @ copies[right]).tolist()):
        links[n] += k
    if not same:
        for n, k in zip(node[right].tolist(), (copies[left] @ count).tolist()):
            links[n] += k
    # smallest node reachable inside the block, by spreading minima until still
    big = np.iinfo(np.int64).max
    low_l, low_r = node[left].copy(), node[right].copy()
    while True:
        new_l = np.minimum(low_l, np.where(near, low_r[None, :], big).min(axis=1))
        if same:
            new_r = new_l
        else:
            new_r = np.minimum(low_r, np.where(near, new_l[:, None], big).min(axis=0))
        if (new_l == low_l).all() and (new_r == low_r).all():
            break
        low_l, low_r = new_l, new_r
    root = {}
    for n, r in zip(np.concatenate([node[left], node[right]]).tolist(), np.concatenate([low_l, low_r]).tolist()):
        root[n] = min(r, root.get(n, r))
    return [(n, links[n], root[n]) for n in root]


def cosine_groups(vectors: DataFrame, least: float = 0.93, codes: int = 12, words: int = 40,
                  tail: float = 3.0, id_col: str = "vec_id",
                  vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows link when their labels are equal and not null, their lengths are equal
    and the double-precision cosine is at least ``least``. Equal vectors of a
    label are one vertex with a count, so a group of copies costs one row. Each
    vertex is sent to every cap filter it exceeds; inside a filter all members
    are compared, in blocks of ``CHUNK`` x ``CHUNK``, the blocks of a large
    filter in tasks of their own. Only verified pairs count, each once, and a
    block returns one row per member, never its pairs. Vectors of fewer than
    ``ALL_PAIRS`` dimensions share one filter, so all of a label are compared. Of
    the others, pairs that share no filter are missed: with the defaults a vector
    has 20 to 25 filters and 1 in 100 pairs at 0.93 shares none (recall is measured
    in the tests). ``words`` and ``tail`` hold for labels of up to ``LEVEL_ROWS``
    distinct vectors; larger ones get rarer and more filters by their number
    (``level_code``), so that buckets, and the comparisons of a vector, stay as they
    are while its filters grow with the logarithm of the label.

    Vectors that are null, zero, empty or hold null or non-finite components,
    and those without label or id, link with nothing: no links, component their
    own id. Rows that repeat an id and vector are copies and link with each
    other; rows of one id with different vectors or labels are apart. Other columns
    are not read; an empty table gives an empty result.
    """
    # floats travel as floats; all arithmetic is in doubles
    wide = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{wide}>").alias("v"),
                          F.col(label_col).alias("label"))
    sound = F.expr("vec_id is not null and label is not null and v is not null and size(v) > 0"
                   " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
                   " and exists(v, x -> x <> 0)")
    ok = rows.where(F.coalesce(sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(wide)))
    distinct = materialize(ok.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
                           .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    level = F.lit(0)
    for n in range(TOP_LEVEL):
        level = F.when(F.col("n") > LEVEL_ROWS * 4 ** n, n + 1).otherwise(level)
    levels = materialize(distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEVEL_ROWS)
                         .select("label", "dim", level.alias("level")), "levels")
    kind = vectors.schema[label_col].dataType

    def listed(batches):
        made = {}
        for b in batches:
            vs = b.column("v").to_pylist()
            dims, at_level = b.column("dim").to_numpy(), b.column("level").to_numpy()
            filters = [None] * len(vs)
            for d, k in sorted(set(zip(dims.tolist(), at_level.tolist()))):
                at = np.flatnonzero((dims == d) & (at_level == k))
                if d < ALL_PAIRS:
                    for i in at:
                        filters[i] = np.zeros(1, np.int32)
                    continue
                if (d, k) not in made:
                    made[d, k] = ProductCode(d, codes, *level_code(codes, words, tail, k))
                for i, f in zip(at, made[d, k].decode(unit(np.array([vs[i] for i in at])))):
                    filters[i] = f
            cols = [b.column(c) for c in ("label", "node", "copies", "v", "dim")] + [pa.array(filters, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "node", "copies", "v", "dim", "filters"])

    leveled = (distinct.join(levels, ["label", "dim"], "left")
               .select("label", "node", "copies", "v", "dim", F.coalesce("level", F.lit(0)).alias("level")))
    sent = arrow_map(leveled, listed, f"label {kind.simpleString()}, node long, copies long, v array<{wide}>, dim int, filters array<int>")
    sent = materialize(sent, "filters")
    keyed = sent.select("*", F.explode("filters").alias("f"))
    sizes = (keyed.groupBy("label", "dim", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("label", "dim", "f", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    met = keyed.join(sizes, ["label", "dim", "f"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    blocks = (met.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
              .select("label", "dim", "f", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"),
                      "c", "node", "copies", "v", "filters"))
    place = ["label", "dim", "f", "i", "j"]
    # enough partitions that one holds a few thousand rows; blocks are then runs of a sorted partition
    blocks = blocks.repartition(*place).sortWithinPartitions(*place)
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def verify(batches):
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            now = pa.concat_tables([held, now]) if held is not None else now
            starts = _runs(now, place)
            for s, e in zip(starts, starts[1:]):
                yield from block(now.slice(s, e - s))
            held = now.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from block(held)

    def block(t):
        if t.num_rows < 2:
            return
        i, j, f = (t.column(c)[0].as_py() for c in ("i", "j", "f"))
        c = t.column("c").to_numpy()
        x = unit(t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        left = np.flatnonzero(c == i)
        right = left if i == j else np.flatnonzero(c == j)
        yield from batches_of_links(bucket_links(x, node, copies, t.column("filters").to_pylist(), left, right, f, least))

    def batches_of_links(found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    found = materialize(arrow_map(blocks, verify, "node long, links long, root long"), "found")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(
        roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "links", "root")
    known = (distinct.join(links, "node", "left")
             .select("label", "v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("root", "node").alias("root")))
    known = materialize(known, "known")
    low = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "low")
    linked = ok.join(known.join(low, "root").drop("root", "first"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                               F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _runs(t: pa.Table, place: list[str]) -> list[int]:
    """Row numbers at which the values of ``place`` change, 0 first."""
    if t.num_rows == 0:
        return [0]
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for c in place:
        col = t.column(c).combine_chunks()
        codes = np.asarray(col.dictionary_encode().indices if hasattr(col, "dictionary_encode") else col)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change).tolist()
