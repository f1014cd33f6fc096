"""WARC archives as a PySpark Python data source, ``format("warc")``, and pages kept in them.

Writing: each task writes archives of its own, every record a gzip member that names its lengths in
an extra field; the commit lists the archives of the tasks that succeeded, so what a lost executor
left behind is never read.  Reading: a partition is one archive, or several small ones.  Of each record
the header is parsed first.  Predicates on the columns that come from headers (record type, target,
date, digest, ...) are pushed down and decided there, and a record that fails them, or whose payload is not
in the schema, is passed over: by a seek in plain archives and in members with lengths, else by
inflating without decoding.  Paths are URIs that ``pyarrow.fs`` opens (file, hdfs, s3, gs).

Pages: of records with equal payloads of at least ``LEAST_BYTES`` the smallest page_id's holds the
payload and the others are revisits of it.

Cases: null html is an empty payload; rows that share the smallest page_id and the payload
are all responses; a null page_id is the smallest only if all are null; a null url has no target;
control characters and spaces of a url are percent-encoded; a very long page is one record and is held
once or twice in its task; a broken or cut archive is an error that names it; an empty table
gives an empty archive folder and no rows; further columns are ignored.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivena.llm import decontaminate
from scrivena.plans.staging import shared_dir, stage

LEAST_BYTES = 100
ARCHIVE_BYTES = 1 << 30
PARTITION_BYTES = 128 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
CHUNK = 1 << 16

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, "
    "payload_digest string, refers_to string, headers map<string, string>, payload binary"
)
#: Columns that a header holds, by the header's name.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "content_length": "content-length",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
END = b"\r\n\r\n"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


# Records as bytes


def record(fields: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    """A record with the header fields that are not null, and its length."""
    lines = [VERSION, *(f"{name}: {_UNSAFE.sub(lambda c: f'%{ord(c[0]):02X}', value)}".encode() for name, value in fields if value is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + END + block + END


def member(body: bytes, level: int) -> bytes:
    """``body`` as a gzip member whose extra field ``sl`` holds its compressed and its plain length, where 32 bits do."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(body) + deflate.flush()
    tail = zlib.crc32(body).to_bytes(4, "little") + (len(body) & 0xFFFFFFFF).to_bytes(4, "little")
    head = b"\x1f\x8b\x08%c\0\0\0\0\0\xff"
    total = 24 + len(packed) + 8
    if max(total, len(body)) >> 32:
        return head % 0 + packed + tail
    lengths = total.to_bytes(4, "little") + len(body).to_bytes(4, "little")
    return head % 4 + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + lengths + packed + tail


class Plain:
    """An archive's bytes, taken or passed over from the front."""

    def __init__(self, file: pa.NativeFile, name: str):
        self.file, self.name, self.buffer = file, name, b""
        self.size = file.size()

    def more(self) -> bytes:
        return self.file.read(CHUNK)

    def broken(self, why: str) -> ValueError:
        return ValueError(f"{self.name}: {why} before byte {self.file.tell()}")

    def head(self) -> bytes | None:
        """What stands before the next empty line; None at the end."""
        parts, tail = [self.buffer], self.buffer
        while (at := tail.find(END)) < 0:
            if not (found := self.more()):
                if b"".join(parts).strip():
                    raise self.broken("a header without end")
                return None
            parts.append(found)
            tail = tail[-3:] + found
        whole = b"".join(parts)
        at += len(whole) - len(tail)
        self.buffer = whole[at + len(END) :]
        return whole[:at]

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            if not (found := self.more()):
                raise self.broken("a record is cut off")
            parts.append(found)
            have += len(found)
        whole = parts[0] if len(parts) == 1 else b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def pass_over(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
            return
        n -= len(self.buffer)
        self.buffer = b""
        self.jump(n)

    def jump(self, n: int) -> None:
        if self.file.tell() + n > self.size:
            raise self.broken("a record is cut off")
        self.file.seek(n, 1)


class Gzip(Plain):
    """An archive of gzip members."""

    def __init__(self, file: pa.NativeFile, name: str):
        super().__init__(file, name)
        self.inflate, self.packed, self.end, self.left = None, b"", None, 0

    def _begin(self) -> bool:
        """Open the next member, if there is one, and note its end where it tells its lengths."""
        at = self.file.tell() - len(self.packed)
        while len(self.packed) < 24 and (found := self.file.read(CHUNK)):
            self.packed += found
        if not self.packed:
            return False
        self.inflate, self.end = zlib.decompressobj(31), None
        if self.packed[3:4] == b"\x04" and self.packed[12:16] == b"sl\x08\0":
            self.end = at + int.from_bytes(self.packed[16:20], "little")
            self.left = int.from_bytes(self.packed[20:24], "little")
        return True

    def more(self) -> bytes:
        while True:
            if self.inflate is None and not self._begin():
                return b""
            self.packed = self.packed or self.file.read(CHUNK)
            if not self.packed:
                raise self.broken("a member is cut off")
            try:
                found = self.inflate.decompress(self.packed, 16 * CHUNK)
            except zlib.error as fault:
                raise self.broken(f"a member is broken ({fault})") from fault
            self.packed = self.inflate.unconsumed_tail
            self.left -= len(found)
            if self.inflate.eof:
                self.packed, self.inflate = self.inflate.unused_data, None
            if found:
                return found

    def jump(self, n: int) -> None:
        if self.inflate is not None and self.end is not None and n == self.left:
            if self.end > self.size:
                raise self.broken("a member is cut off")
            self.file.seek(self.end)
            self.inflate, self.packed = None, b""
            return
        while n > 0:
            if not (found := self.more()):
                raise self.broken("a record is cut off")
            self.buffer = found[n:]
            n -= len(found)


def headers_of(head: bytes, archive: Plain) -> dict[str, str]:
    """Fields of a header by their lower-case names; lines that begin with a space go on with the one before."""
    lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise archive.broken("no record where one should begin")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    if not fields.get("content-length", "").isdecimal():
        raise archive.broken("a record without length")
    return fields


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What a block carries: of an HTTP message the part after its head."""
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(END)[2]
    return block


# Predicates


def column(fields: dict[str, str], name: str) -> str | int | None:
    value = fields.get(HEADERS[name])
    return int(value) if name == "content_length" and value is not None else value


_COMPARED: dict[type, Callable] = {
    ds.EqualTo: lambda v, x: v == x,
    ds.GreaterThan: lambda v, x: v > x,
    ds.GreaterThanOrEqual: lambda v, x: v >= x,
    ds.LessThan: lambda v, x: v < x,
    ds.LessThanOrEqual: lambda v, x: v <= x,
    ds.In: lambda v, x: v in x,
    ds.StringStartsWith: lambda v, x: v.startswith(x),
    ds.StringEndsWith: lambda v, x: v.endswith(x),
    ds.StringContains: lambda v, x: x in v,
}


def decided(predicate: ds.Filter) -> bool:
    """Whether headers alone decide a filter."""
    if isinstance(predicate, ds.Not):
        return decided(predicate.child)
    known = isinstance(predicate, (ds.EqualNullSafe, ds.IsNull, ds.IsNotNull, *_COMPARED))
    return known and len(predicate.attribute) == 1 and predicate.attribute[0] in HEADERS


def holds(predicate: ds.Filter, fields: dict[str, str]) -> bool | None:
    """True, False, or None for SQL's unknown."""
    if isinstance(predicate, ds.Not):
        found = holds(predicate.child, fields)
        return None if found is None else not found
    value = column(fields, predicate.attribute[0])
    if isinstance(predicate, ds.IsNull):
        return value is None
    if isinstance(predicate, ds.IsNotNull):
        return value is not None
    if isinstance(predicate, ds.EqualNullSafe):
        return value == predicate.value
    if value is None or predicate.value is None:
        return None
    return _COMPARED[type(predicate)](value, predicate.value)


# The source


@dataclass
class Archives(ds.InputPartition):
    """Names of the archives that one task reads, one after the other."""

    names: list[str]


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the archives of a folder: those its commits name, if there are any, or else all; or of a single archive."""
    files, top = _opened(path)
    if files.get_file_info(top).type == pa.fs.FileType.File:
        return [(top, files.get_file_info(top).size)]
    found = {posixpath.basename(f.path): f for f in files.get_file_info(pa.fs.FileSelector(top)) if f.type == pa.fs.FileType.File}
    commits = [name for name in found if name.startswith("_committed-")]
    if commits:
        names = [n for c in commits for n in files.open_input_stream(f"{top}/{c}").read().decode().split()]
    else:
        names = [n for n in found if re.search(r"\.warc(\.gz)?$", n)]
    return [(found[n].path, found[n].size) for n in sorted(names)]


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.columns, self.partition_bytes = path, schema.fieldNames(), partition_bytes
        unknown = set(self.columns) - set(HEADERS) - {"headers", "payload"}
        if unknown:
            raise ValueError(f"columns that a WARC record doesn't have: {sorted(unknown)}")
        self.predicates: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for predicate in filters:
            if decided(predicate):
                self.predicates.append(predicate)
            else:
                yield predicate

    def partitions(self) -> Sequence[ds.InputPartition]:
        groups: list[list[str]] = []
        room = 0
        for name, size in listed(self.path):
            if size > room or not groups:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(name)
            room -= size
        return [Archives(names) for names in groups] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        kinds = {"content_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows: list[list] = []
        held = 0
        for name in partition.names:
            with files.open_input_file(name) as file:
                for fields, payload in self._records((Gzip if name.endswith(".gz") else Plain)(file, name)):
                    own = {"payload": payload, "headers": list(fields.items())}
                    rows.append([own[c] if c in own else column(fields, c) for c in self.columns])
                    held += len(payload or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self._batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    def _records(self, archive: Plain) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Headers and payloads (None if that is not a column) of the records for which the predicates hold."""
        decode = "payload" in self.columns
        while (head := archive.head()) is not None:
            fields = headers_of(head, archive)
            length = int(fields["content-length"])
            if not all(holds(p, fields) for p in self.predicates):
                archive.pass_over(length + len(END))
            elif decode:
                block = archive.take(length)
                archive.pass_over(len(END))
                yield fields, payload_of(fields, block)
            else:
                archive.pass_over(length + len(END))
                yield fields, None

    @staticmethod
    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows with record_type, record_id, target_uri, date, refers_to, payload_digest, payload_bytes, payload and other (a map of further fields)."""

    def __init__(self, path: str, overwrite: bool, level: int, archive_bytes: int):
        self.path, self.overwrite, self.level, self.archive_bytes = path, overwrite, level, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _opened(self.path)
        files.create_dir(top, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for k in range(0, batch.num_rows, 64):
                    for row in batch.slice(k, 64).to_pylist():
                        if out is None:
                            names.append(f"{uuid.uuid4().hex}.warc.gz")
                            out = files.open_output_stream(f"{top}/{names[-1]}", compression=None)
                            size = out.write(member(about(names[-1]), self.level))
                        size += out.write(member(page_record(row), self.level))
                        if size >= self.archive_bytes:
                            out.close()
                            out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, top = _opened(self.path)
        files.create_dir(top, recursive=True)
        before = [f.path for f in files.get_file_info(pa.fs.FileSelector(top))] if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.names]
        with files.open_output_stream(f"{top}/_committed-{uuid.uuid4().hex}") as out:
            out.write("\n".join(names).encode())
        for old in before:
            if posixpath.basename(old) not in names:
                files.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, top = _opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            files.delete_file(f"{top}/{name}")


def about(name: str) -> bytes:
    """The record that an archive begins with."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(name.partition('.')[0])}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return record(fields, b"software: scrivena\r\nformat: WARC File Format 1.1\r\n")


def page_record(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", row["payload_digest"]),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", row["refers_to"]),
        *(row["other"] or []),
        ("Content-Type", HTTP),
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % row["payload_bytes"] + END
    return record(fields, block if revisit else block + row["payload"])


class WarcDataSource(ds.DataSource):
    """Options: path; compression_level, archive_bytes (writing); partition_bytes (reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        level, most = self.options.get("compression_level", 6), self.options.get("archive_bytes", ARCHIVE_BYTES)
        return WarcWriter(self.options["path"], overwrite, int(level), int(most))


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session, with its predicates pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of the archives at ``path``; without ``payload`` among the columns no payload is decoded."""
    register(spark)
    kinds = dict(c.strip().split(" ", 1) for c in re.split(r", (?!string>)", SCHEMA))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(path)


def write(records: DataFrame, path: str, **options: int) -> None:
    """Add ``records`` (columns as of ``WarcWriter``) to the archives at ``path``."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


# Pages


def record_id(page_id: Column, digest: Column) -> Column:
    """A name for the record of a page's payload; rows that repeat both share it."""
    name = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html), in the columns that the writer takes.

    Pages whose payload no other has are told by a bit for each shared digest and are not shuffled.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = stage(groups.filter("n > 1").select("digest", "first"), "warc-shared")
    known = decontaminate._bit_map(shared.select(F.xxhash64("digest").alias("hash")), shared.count(), decontaminate.MOST_BITS)

    @F.pandas_udf("boolean")
    def may_be_shared(hashes: pd.Series) -> pd.Series:
        return pd.Series(known.has(hashes.to_numpy().view(np.uint64)))

    marked = rows.withColumn("maybe", may_be_shared(F.xxhash64("digest")))
    alone = marked.filter("not maybe").withColumns({"first": F.lit(None).cast("long"), "again": F.lit(False)})
    maybe = marked.filter("maybe").join(shared.withColumn("again", F.lit(True)), "digest", "left")
    found = alone.unionByName(maybe)
    revisit = F.coalesce(F.col("again"), F.lit(False)) & (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    own = F.col("page_id").cast("string")
    return found.select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, record_id(F.col("first"), F.col("digest"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.col("bytes").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(own.isNotNull(), F.create_map(F.lit("X-Page-Id"), own)).alias("other"),
    )


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages archived at ``path``.

    Lengths and digests are those of the payloads as they are read back; a revisit has those of the
    record it refers to, and its own payload is never looked for.
    """
    page_id = F.col("headers")["x-page-id"].cast("long").alias("page_id")
    responses = read(spark, path, ["record_type", "record_id", "headers", "payload"]).filter("record_type = 'response'")
    responses = responses.select(page_id, "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    responses = stage(responses, "warc-responses")
    revisits = read(spark, path, ["record_type", "refers_to", "headers"]).filter("record_type = 'revisit'").select(page_id, "refers_to")
    first = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("first"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    again = revisits.join(first, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def archived(pages: DataFrame) -> DataFrame:
    """``pages_of`` the archives that ``pages`` have been written to, in the shared folder."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/scrivena-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(page_records(pages), path)
    return pages_of(spark, path)


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
g as (select page_id, strlen(t) as n, sha256(t) as h, min(page_id) over (partition by t) as first from p)
select page_id, n::bigint as payload_bytes, h as payload_digest,
       case when n >= {LEAST_BYTES} and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when n >= {LEAST_BYTES} and page_id is distinct from first then first end as refers_to
from g
"""
