"""Reversible incremental line dedup: sharded cuckoo filters in front of exact
reference-count tables."""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches_of, scratch_path, ship_package, text_bytes

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 500
SHARD_KEYS = 100_000


def line_key(line: bytes, least: int = 10) -> bytes | None:
    """128-bit key of a line stripped of ASCII white space with A-Z lowered;
    None below ``least`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < least or (not key.isascii() and len(key) - len(re.findall(rb"[\x80-\xbf]", key)) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Membership of 128-bit keys with deletion: buckets of four 16-bit tags,
    two buckets per key. It never misses a member; a stranger passes with about
    8 / 65536. A tag that finds no place after ``KICKS`` moves goes to an exact
    overflow list."""

    def __init__(self, buckets: int, tags: array | None = None, over: list | None = None, members: int = 0):
        self.buckets, self.members, self.over = buckets, members, over or []
        self.tags = array("H", bytes(2 * SLOTS * buckets)) if tags is None else tags

    @classmethod
    def sized(cls, members: int) -> CuckooFilter:
        return cls(1 << max(4, int(members / SLOTS / 0.8)).bit_length())

    @property
    def room(self) -> int:
        return int(0.9 * len(self.tags)) - self.members

    def _places(self, key: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(key[4:6], "little") or 1
        one = int.from_bytes(key[6:14], "little") & (self.buckets - 1)
        return tag, one, self._other(one, tag)

    def _other(self, at: int, tag: int) -> int:
        return at ^ ((tag * 0x5BD1E995) & (self.buckets - 1))

    def __contains__(self, key: bytes) -> bool:
        tag, a, b = self._places(key)
        return (tag in self.tags[a * SLOTS:(a + 1) * SLOTS] or tag in self.tags[b * SLOTS:(b + 1) * SLOTS]
                or bool(self.over) and (min(a, b), tag) in self.over)

    def add(self, key: bytes) -> None:
        self.members += 1
        tag, at, b = self._places(key)
        if self._put(at, tag) or self._put(b, tag):
            return
        for k in range(KICKS):
            slot = at * SLOTS + (k * 7 + tag) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            at = self._other(at, tag)
            if self._put(at, tag):
                return
        self.over.append((min(at, self._other(at, tag)), tag))

    def _put(self, bucket: int, tag: int) -> bool:
        for s in range(bucket * SLOTS, (bucket + 1) * SLOTS):
            if not self.tags[s]:
                self.tags[s] = tag
                return True
        return False

    def remove(self, key: bytes) -> None:
        """Take out one copy of a member's tag; the key must have been added."""
        self.members -= 1
        tag, a, b = self._places(key)
        if (min(a, b), tag) in self.over:
            self.over.remove((min(a, b), tag))
            return
        for s in (*range(a * SLOTS, (a + 1) * SLOTS), *range(b * SLOTS, (b + 1) * SLOTS)):
            if self.tags[s] == tag:
                self.tags[s] = 0
                return

    def dump(self) -> bytes:
        flat = [x for pair in self.over for x in pair]
        return array("q", [self.buckets, self.members, len(self.over), *flat]).tobytes() + self.tags.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        head = array("q", data[:24])
        end = 24 + 16 * head[2]
        over = array("q", data[24:end])
        return cls(head[0], array("H", data[end:]), list(zip(over[::2], over[1::2])), head[1])


def line_postings(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key binary, doc_id long)`` for every line key of a document; a key that
    a row repeats comes once."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def rows(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for key in {line_key(x, least) for x in text.split(b"\n")} - {None}:
                    yield key, doc

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)).where("doc_id is not null")
    return arrow_map(docs, lambda batches: batches_of(rows(batches), schema, 16384), "key binary, doc_id long")


KEYS = pa.schema([("key", pa.binary()), ("shard", pa.int32()), ("refs", pa.int64()), ("first", pa.int64()),
                  ("last", pa.int64()), ("home", pa.int32())])
LOG_DDL = "number int, batch string, kind string, postings string, version int, shards int, least int"
KEYS_DDL = "key binary, shard int, refs long, first long, last long, home int"


class LineStore:
    """Line state in the shared folder, in Parquet tables; a change writes new
    ones and reads the old ones.

    ``postings``  (key, doc_id, live): a document holds a key (1) or gave it up
                  (-1): the exact source of every count.
    ``counts``    (key, shard, refs, first, last, home): how many documents hold
                  a key, the smallest and largest of them, and the filter of the
                  shard that has its tag.
    ``filters``   (shard, home, filter): a shard's cuckoo filters; when the last
                  is full the next is opened, so none is ever rebuilt.

    ``log``       (number, batch, kind, postings, version, shards, least): a row per
                  change, written last. A change is there once its row is; one
                  that failed before left files that the next change replaces.

    ``insert`` counts a batch's keys before the shuffle and sends each key once
    to its shard. A key that no filter of the shard holds is new and needs no
    look-up; only the others are joined with the exact counts. ``delete`` counts
    the keys of leaving documents anew from the postings; keys without a holder
    leave counts and filters. Shards follow the key's hash, so a line that fills
    a third of all documents is one row of one shard; when shards hold more than
    twice ``SHARD_KEYS`` keys on average, all keys are dealt to more shards.

    A store is opened again by its ``path``, by one writer at a time.
    """

    def __init__(self, spark: SparkSession, least: int = 10, shards: int | None = None, path: str | None = None):
        self.spark, self.least, self.shards = spark, least, shards
        self.path = path or scratch_path(spark, f"lines-{uuid.uuid4().hex}")
        self.log: list[str] = []
        self.batches: set[str] = set()
        self.version = 0
        if path:
            self._reopen()

    def _reopen(self) -> None:
        """The state of the last change in the log, if there is a log."""
        from pyspark.errors import AnalysisException
        try:
            rows = self.spark.read.schema(LOG_DDL).parquet(f"{self.path}/log").orderBy("number").collect()  # one a change
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        for r in rows:
            self.log.append(r["postings"])
            self.batches |= {r["batch"]} - {None}
            self.version, self.shards, self.least = r["version"], r["shards"], r["least"]

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{name}-{self.version}")

    def counts(self) -> DataFrame:
        return self._table("counts", KEYS_DDL)

    def filters(self) -> DataFrame:
        return self._table("filters", "shard int, home int, filter binary")

    def postings(self) -> DataFrame:
        """Live ``(key, doc_id)``, each once."""
        if not self.log:
            return self.spark.createDataFrame([], "key binary, doc_id long")
        log = self.spark.read.parquet(*[f"{self.path}/{x}" for x in self.log])
        if any(x.startswith("gone") for x in self.log):
            log = log.groupBy("key", "doc_id").agg(F.sum("live").alias("live")).where("live > 0")
        return log.select("key", "doc_id")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Add documents. A ``batch`` name that the store has taken before does
        nothing, and documents whose ids it holds are left out, so an insert can be
        repeated. Rows that share an id are one document; rows with a null id hold
        nothing."""
        if batch is not None and batch in self.batches:
            return
        held = line_postings(docs, self.least, id_col, text_col).distinct().withColumn("live", F.lit(1))
        if self.log:
            held = held.join(self.postings().select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id", "live")
        name = f"held-{len(self.log)}"
        held = self._save(held, name)
        self.shards = self.shards or 16 + held.count() // SHARD_KEYS
        new = self._counted(held)
        old, stored = self.counts(), self.version > 0
        if stored:
            new = self._save(self._probe(new), f"probed-{self.version + 1}")
            maybe = new.where("maybe").drop("maybe")
            met = (maybe.alias("n").join(old.alias("o"), "key")
                   .select("key", "o.shard", (F.col("n.refs") + F.col("o.refs")).alias("refs"),
                           F.least("n.first", "o.first").alias("first"), F.greatest("n.last", "o.last").alias("last"), "o.home"))
            new = new.where("not maybe").drop("maybe").union(maybe.join(old, "key", "left_anti"))
        new = self._save(self._tags(new.withColumn("home", F.lit(None).cast("int")).select(*KEYS.names), self.filters()),
                         f"tagged-{self.version + 1}")
        counts = new.where("filter is null").select(*KEYS.names)
        if stored:
            counts = counts.union(met).union(old.join(met.select("key"), "key", "left_anti").select(*KEYS.names))
        self._commit(counts, new, name, "insert", batch)

    def delete(self, docs: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out by their ids, whatever their texts are now; the state is
        as if they had never come. Ids that the store does not hold change nothing."""
        if not self.log:
            return
        ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        name = f"gone-{len(self.log)}"
        gone = self._save(self.postings().join(ids, "doc_id", "left_semi").select("key", "doc_id", F.lit(-1).alias("live")), name)
        hit, old = gone.select("key").distinct(), self.counts()
        stay = self.postings().join(gone, ["key", "doc_id"], "left_anti")
        now = self._counted(stay.join(hit, "key", "left_semi"))
        now = now.join(old.select("key", "home"), "key").select(*KEYS.names)
        dead = old.join(hit, "key", "left_semi").join(now, "key", "left_anti").select(*KEYS.names)
        tags = self._save(self._tags(dead, self.filters()), f"tagged-{self.version + 1}")
        self._commit(old.join(hit, "key", "left_anti").select(*KEYS.names).union(now), tags, name, "delete", None)

    def _counted(self, postings: DataFrame) -> DataFrame:
        return (postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"),
                                            F.max("doc_id").alias("last"))
                .select("key", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "refs", "first", "last"))

    def _commit(self, counts: DataFrame, tagged: DataFrame, postings: str, kind: str, batch: str | None) -> None:
        """Counts and filters of the next version, then the change's row in the log."""
        v = self.version + 1
        filters = tagged.where("filter is not null").select("shard", "home", "filter")
        filters = filters.union(self.filters().join(filters, "shard", "left_anti").select("shard", "home", "filter"))
        counts = self._save(counts, f"counts-{v}")
        n = counts.count()
        if n > 2 * SHARD_KEYS * self.shards:
            self.shards, v = 16 + n // SHARD_KEYS, v + 1
            shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
            dealt = counts.withColumn("shard", shard).withColumn("home", F.lit(None).cast("int")).select(*KEYS.names)
            none = self.spark.createDataFrame([], "shard int, home int, filter binary")
            tagged = self._save(self._tags(dealt, none), f"tagged-{v}")
            self._save(tagged.where("filter is null").select(*KEYS.names), f"counts-{v}")
            filters = tagged.where("filter is not null").select("shard", "home", "filter")
        self._save(filters, f"filters-{v}")
        row = [(len(self.log) + 1, batch, kind, postings, v, int(self.shards), self.least)]
        self.spark.createDataFrame(row, LOG_DDL).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.version = v
        self.log.append(postings)
        self.batches |= {batch} - {None}

    def _probe(self, batch: DataFrame) -> DataFrame:
        """The batch's keys with ``maybe``: a filter of the shard holds the tag."""
        ship_package(self.spark)

        def shard(keys: pa.Table, held: pa.Table) -> pa.Table:
            filters = [CuckooFilter.load(x) for x in held.column("filter").to_pylist()]
            maybe = [any(k in f for f in filters) for k in keys.column("key").to_pylist()]
            return keys.append_column("maybe", pa.array(maybe, pa.bool_()))

        return (batch.groupBy("shard").cogroup(self.filters().groupBy("shard"))
                .applyInArrow(shard, "key binary, shard int, refs long, first long, last long, maybe boolean"))

    def _tags(self, keys: DataFrame, held: DataFrame) -> DataFrame:
        """Keys without a home are added to their shard's last filter with room
        and get its number, keys with one are removed from it. Returns the keys,
        then the shard's filters as rows with ``filter`` set."""
        ship_package(self.spark)
        out = KEYS.append(pa.field("filter", pa.binary()))

        def shard(change: pa.Table, held: pa.Table) -> pa.Table:
            if not change.num_rows:
                return out.empty_table()
            filters = {h: CuckooFilter.load(x) for h, x in zip(held.column("home").to_pylist(), held.column("filter").to_pylist())}
            names, homes = change.column("key").to_pylist(), change.column("home").to_pylist()
            left = homes.count(None)
            for i, (key, home) in enumerate(zip(names, homes)):
                if home is not None:
                    filters[home].remove(key)
                    continue
                last = max(filters, default=-1)
                if last < 0 or filters[last].room < 1:
                    last += 1
                    filters[last] = CuckooFilter.sized(max(left, 1000))
                filters[last].add(key)
                homes[i], left = last, left - 1
            n = change.column("shard")[0].as_py()
            rows = change.set_column(5, "home", pa.array(homes, pa.int32())).append_column(
                "filter", pa.nulls(len(names), pa.binary())).cast(out)
            kept = [(None, n, None, None, None, h, f.dump()) for h, f in filters.items()]
            return pa.concat_tables([rows, pa.Table.from_batches(batches_of(iter(kept), out), out)])

        return (keys.groupBy("shard").cogroup(held.groupBy("shard"))
                .applyInArrow(shard, KEYS_DDL + ", filter binary"))

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with the lines dropped that a smaller document holds too: its
        columns, the text rewritten, and ``n_lines`` (before) and ``n_dropped``
        in the place of any such columns. Lines with equal keys inside the
        smallest holder stay, short lines stay, and rows with a null id keep
        every line. A null text is one empty line."""
        dup = self.counts().where(F.col("first") < F.col("last")).select("key", "first")
        drops = (self.postings().join(dup, "key").where(F.col("doc_id") != F.col("first"))
                 .groupBy("doc_id").agg(F.collect_set("key").alias("drops")).withColumnRenamed("doc_id", "holder"))
        rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
        carried = docs.select(F.struct(*rest).alias("rest"), F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
        kind = carried.schema["rest"].dataType.simpleString()
        joined = carried.join(drops, F.col("id") == F.col("holder"), "left").select("rest", "text", "drops")
        least = self.least

        def run(batches):
            for b in batches:
                texts, lines, dropped = [], [], []
                for text, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    parts = text.split(b"\n")
                    kept = parts
                    if keys:
                        keys = set(keys)
                        kept = [x for x in parts if line_key(x, least) not in keys]
                    texts.append(b"\n".join(kept).decode("utf-8", "replace"))
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(kept))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()),
                                                  pa.array(dropped, pa.int64())], ["rest", "text", "n_lines", "n_dropped"])

        out = arrow_map(joined, run, f"rest {kind}, text string, n_lines long, n_dropped long")
        cols = {c: F.col("rest")[c] for c in rest} | {text_col: F.col("text")}
        return out.select(*[cols[c].alias(c) for c in docs.columns if c in cols], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, least: int = 10, increments: int = 2,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert all of ``docs`` into a new store, in ``increments`` by hash of the
    id (the filters of the earlier ones screen the later ones), and rewrite
    every row. The result does not depend on their number."""
    store = LineStore(docs.sparkSession, least)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(increments))
    for i in range(increments):
        store.insert(docs.where(part == i), id_col, text_col)
    return store.rewrite(docs, id_col, text_col)
