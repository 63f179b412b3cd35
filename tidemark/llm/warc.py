"""WARC archives as a PySpark data source: writer and reader."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tidemark.llm.common import ship_package

SCHEMA = ("record_type string, record_id string, page_id long, target_uri string, payload_digest string, payload_length long,"
          " refers_to long, headers map<string,string>, payload binary")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Names of the lists that commits write, one each; readers take their union.
LIST = re.compile(r"_archives(-[0-9a-f]+)?\.json")
#: column -> header, and how the header's text becomes the column
FIELDS = {"record_type": ("warc-type", str), "record_id": ("warc-record-id", str), "page_id": ("x-page-id", int),
          "target_uri": ("warc-target-uri", str), "payload_digest": ("warc-payload-digest", lambda s: s.removeprefix("sha256:")),
          "payload_length": ("x-payload-length", int), "refers_to": ("x-refers-to-page", int)}


def file_system(path: str):
    """pyarrow's file system for a path or URI (local, HDFS, S3, GCS) and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]+:", path) else "file://" + os.path.abspath(path))


def archive_lists(store, root: str) -> list[str]:
    """Paths of the lists in a folder."""
    from pyarrow import fs
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and LIST.fullmatch(x.base_name))


def listed_names(store, path: str) -> list[str]:
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers, block. Line ends in a value become spaces."""
    clean = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers if v is not None]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*clean, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A record as a gzip member. Its header has the extra field ``sl`` with the
    member's and the record's length, so that a reader can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8  # header and length of the extra field, the field, the data, the trailer
    head = (b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, 12)
            + b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Archive(InputPartition):
    """Files that one task reads."""
    paths: list


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcSource(DataSource):
    """``format("warc")``.

    Reading: ``path`` is a folder (or file) of ``.warc`` and ``.warc.gz`` files. A
    partition is a group of files of about ``partition_bytes`` (default 64 MB).
    Equality and ``IN`` on the header columns are pushed down: a record's headers
    are parsed first and a record that fails them is stepped over. Payloads are
    decoded only with ``payload`` true (the default); then a response's HTTP head
    is cut off. Missing headers are null.

    Writing: rows of ``SCHEMA`` (without ``headers``); a task writes one file, each
    commit writes a list of its own of the files of the tasks that succeeded, and
    only listed files are read, so a task that was lost or ran twice leaves no
    trace and a later write adds to an earlier one. Overwriting takes the earlier
    lists and their files away once the new list is there. ``compress`` (default
    true) makes a gzip member of each record.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), [f.name for f in schema])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), [f.name for f in schema], overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.want: dict[str, set] = {}
        self.there: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, IsNotNull):
                self.there.add(name)
            elif name in FIELDS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.want[name] = self.want[name] & values if name in self.want else values
            else:
                yield f

    def partitions(self) -> list[Archive]:
        from pyarrow import fs
        store, root = file_system(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Archive([root])]
        lists = archive_lists(store, root)
        if lists:
            names = set().union(*(listed_names(store, x) for x in lists))
            files = store.get_file_info([f"{root}/{n}" for n in names])
        else:
            files = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        groups, room = [], 0
        for x in sorted(files, key=lambda x: x.path):
            if not groups or x.size > room:
                groups.append(Archive([]))
                room = self.size
            groups[-1].paths.append(x.path)
            room -= x.size
        return groups or [Archive([])]

    def read(self, partition: Archive) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                yield from self._rows(Stream(f))

    def _rows(self, stream: Stream) -> Iterator[tuple]:
        while (rec := stream.next()) is not None:
            head = rec.headers
            row = {}
            for name, (key, kind) in FIELDS.items():
                try:
                    row[name] = kind(head[key]) if key in head else None
                except ValueError:
                    row[name] = None
            if any(row[k] is None for k in self.there) or any(row[k] not in v or row[k] is None for k, v in self.want.items()):
                rec.skip()
                continue
            row["headers"], row["payload"] = head, None
            if self.payload and "payload" in self.columns and row["record_type"] != "revisit":
                block = rec.block()
                row["payload"] = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            else:
                rec.skip()
            yield tuple(row[c] for c in self.columns)


class Stream:
    """Records of an open archive, plain or in gzip members, one at a time."""

    def __init__(self, f):
        self.f, self.held = f, b""

    def _fill(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.f.read(max(1 << 16, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def _take(self, n: int) -> bytes:
        self._fill(n)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def _drop(self, n: int) -> None:
        if n > len(self.held):
            n -= len(self.held)
            self.held = b""
            while n > 0 and (gone := len(self.f.read(min(n, 1 << 20)))):
                n -= gone
        else:
            self.held = self.held[n:]

    def next(self) -> Record | None:
        while self._fill(2) and self.held[:2] == b"\r\n":
            self.held = self.held[2:]
        if not self._fill(10):
            return None
        return self._packed() if self.held[:2] == b"\x1f\x8b" else self._plain()

    def _plain(self) -> Record:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._fill(len(self.held) + 1):
                raise ValueError("archive ends inside a header")
        headers = parse(self._take(end + 4))
        n = int(headers.get("content-length", 0))
        return Record(headers, lambda: self._take(n), lambda: self._drop(n))

    def _packed(self) -> Record:
        size = None
        self._fill(12)
        if self.held[3] & 4:
            extra = struct.unpack_from("<H", self.held, 10)[0]
            self._fill(12 + extra)
            at = 12
            while at + 4 <= 12 + extra:
                tag, n = self.held[at:at + 2], struct.unpack_from("<H", self.held, at + 2)[0]
                if tag == b"sl" and n == 8:
                    size = struct.unpack_from("<I", self.held, at + 4)[0]
                at += 4 + n
        if size:
            if not self._fill(size):
                raise ValueError("archive ends inside a record")
            view = self.held
            opener = zlib.decompressobj(31)
            head, rest = opener.decompress(view[:size], 4096), None
            while b"\r\n\r\n" not in head:
                more = opener.decompress(opener.unconsumed_tail, 4096)
                if not more:
                    raise ValueError("a record without an end of headers")
                head += more
            first, _, start = head.partition(b"\r\n\r\n")
            self.held = view[size:]
            headers = parse(first + b"\r\n\r\n")
            n = int(headers.get("content-length", 0))
            return Record(headers, lambda: (start + opener.decompress(opener.unconsumed_tail))[:n], lambda: rest)
        opener, data = zlib.decompressobj(31), b""
        while not opener.eof:
            if not self.held and not self._fill(1):
                raise ValueError("archive ends inside a record")
            data += opener.decompress(self.held)
            self.held = opener.unused_data
        first, _, block = data.partition(b"\r\n\r\n")
        headers = parse(first + b"\r\n\r\n")
        return Record(headers, lambda: block[:int(headers.get("content-length", 0))], lambda: None)


@dataclass
class Record:
    headers: dict
    block: object
    skip: object


def parse(head: bytes) -> dict[str, str]:
    """Header names in lower case; a line that begins with white space goes on
    with the line before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool = False):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.compress = options.get("compress", "true").lower() == "true"

    def write(self, rows) -> Written:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress, 0
        with store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as f:
            for row in rows:
                r = dict(zip(self.columns, row))
                data = page_record(r)
                f.write(member(data) if self.compress else data)
                n += 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        earlier = archive_lists(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/_archives-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.records)).encode())
        for path in earlier:
            names = listed_names(store, path)
            store.delete_file(path)
            for name in names:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        store, root = file_system(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


def page_record(r: dict) -> bytes:
    """The record of a row: a response with its HTTP message, or a revisit
    without a block that names the page whose payload is the same."""
    kind = r["record_type"]
    payload = bytes(r.get("payload") or b"")
    text = lambda v: None if v is None else str(v)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", r.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"),
               ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", r.get("target_uri")), ("X-Page-ID", text(r.get("page_id"))),
               ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}" if r.get("payload_digest") else None),
               ("X-Payload-Length", text(r.get("payload_length")))]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("X-Refers-To-Page", text(r.get("refers_to")))]
        return record(headers, b"")
    return record([*headers, ("Content-Type", "application/http; msgtype=response")], HTTP + payload)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows of ``SCHEMA`` for ``pages(page_id, url, html)``: of equal payloads of
    at least ``least`` bytes the smallest page is the response and the others are
    revisits, whose payload is left out; a null html is an empty payload. Of rows
    that repeat the smallest page, each is a response. Null pages come after all
    numbers; a group of null pages only is all responses.

    Smallest pages are found on digests alone, with partial minima, and only
    digests with a second page are joined back: nothing but that join moves
    payloads, and adaptive execution splits its hot digests."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), body.alias("payload"),
                        F.sha2(body, 256).alias("payload_digest"), F.length(body).cast("long").alias("payload_length"))
    first = (rows.where(F.col("payload_length") >= least).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
             .select(F.col("payload_digest").alias("d"), "first"))
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return (rows.join(first, F.col("payload_digest") == F.col("d"), "left")
            .select(F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit(None).cast("string").alias("record_id"),
                    "page_id", "target_uri", "payload_digest", "payload_length", F.when(again, F.col("first")).alias("refers_to"),
                    F.when(~again, F.col("payload")).alias("payload")))


def write_archives(records: DataFrame, path: str, compress: bool = True, overwrite: bool = False) -> None:
    """Add the records to the folder's archives, or replace them."""
    register(records.sparkSession)
    records.write.format("warc").mode("overwrite" if overwrite else "append").option("path", path).option("compress", str(compress).lower()).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all committed archives of a folder as ``SCHEMA``; without
    ``payload`` no payload is decoded. An empty folder has no rows; fields that a
    record lacks or that do not parse are null, very long payloads are read whole
    and one at a time."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
