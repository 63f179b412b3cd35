"""SimHash near-duplicates: pigeonhole blocks over fingerprints, verified by
Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, materialize, text_bytes
from tidemark.llm.components import connected_components

CHUNK = 1 << 16


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of UTF-8 bytes: A-Z lower-cased, words cut at ASCII white
    space, shingles of ``shingle`` words with repeats (fewer words: the whole
    sequence; none: 0). A bit is set when over half of the shingle hashes have it."""
    words = data.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, fp long)`` for every row; null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")),
                     run, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, hot: int = 64) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``distinct(fp)``
    that connect all pairs within ``max_bits`` (0 or 2), and no others.

    64 bits are cut into ``max_bits + 2`` blocks; a pair within the distance
    agrees on at least two whole blocks, so the fingerprints are joined on
    every choice of two blocks and verified. A bucket of more than ``hot``
    fingerprints is not paired off: each member is keyed once more by itself
    and by its one-bit neighbours outside the bucket's blocks. Two members
    within two bits share such a key, members sharing a key are within two
    bits, and the smallest member of a key stands for it. That is linear in the
    bucket and leaves the same components.
    """
    if max_bits not in (0, 2):
        raise ValueError("max_bits must be 0 or 2")
    if max_bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    n = max_bits + 2
    cut = [64 * i // n for i in range(n + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cut, cut[1:])]
    masks = [sum(block[i] for i in keep) for keep in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for i, m in enumerate(signed)])).alias("k")).select("fp", "k.c", "k.key")
    sizes = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["c", "key"]), "blocks")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits

    few = shared.where(F.col("n") <= hot).select("c", "key", "fp")
    pairs = (few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["c", "key"])
             .where(F.col("a") < F.col("b")).where(near).select("a", "b"))

    free = F.lit(None)
    for i, m in enumerate(masks):
        bits = [j for j in range(64) if not m >> j & 1]
        flips = [0] + [(1 << j) - (1 << 64) if j == 63 else 1 << j for j in bits]
        free = F.when(F.col("c") == i, F.array(*[F.lit(x).cast("long") for x in flips])).otherwise(free)
    many = (shared.where(F.col("n") > hot)
            .select("c", "key", "fp", F.explode(free).alias("flip"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v")))
    heads = many.groupBy("v").agg(F.min("fp").alias("a"))
    stars = (many.join(heads, "v").select("a", F.col("fp").alias("b"))
             .where(F.col("a") < F.col("b")).where(near))
    return pairs.union(stars).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Equal fingerprints collapse to one before any join, so a group of copies is
    one fingerprint; a component takes the smallest ``doc_id`` of its rows.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id keep a fingerprint and stand outside (component null).
    Repeated ids are separate rows of the same id. Other columns of the input
    are not read. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    reps = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    reps = materialize(reps, "distinct")
    roots = connected_components(fingerprint_links(reps.select("fp"), max_bits))
    roots = roots.withColumnRenamed("node", "fp")
    linked = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = linked.join(low, "root").select("fp", "component_id")
    return (fps.join(named, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
