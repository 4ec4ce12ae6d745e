"""WARC archives as a Spark data source, and the archiving of pages with revisit records.

Files hold one gzip member a record; the member's header carries its lengths ("sl" field), so that a reader can go
from record to record without inflating them. The reader plans partitions of whole files, takes equality, IN,
prefix and null tests on the record's type, id, URI and date from the query, inflates a record's headers first, and
the payload only of records that pass, and only if the schema asked for has it. Files of other writers, plain or
compressed, are read too, with any number of records a member; without lengths a member is inflated to its end. A file
is read by one task, so files of other writers should be split at the usual size of a gigabyte or less.

Paths are those that pyarrow's file systems know. Nulls: a missing field is null; a null payload is written empty.
Records that repeat are each kept. A payload is held whole, one at a time beside a batch of 4 MB. A table without rows
writes no file, and reads as no rows. The source has its own columns only; those of pages are read by name.

Writing is by task attempts: hidden files that the driver renames on commit, so that lost executors leave nothing behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import shared_dir, table

SCHEMA = "type string, record_id string, target_uri string, date string, content_length long, headers map<string,string>, payload binary"
#: Fields of a record and the headers that they are read from.
FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date"}
#: A writer starts a new file beyond this; a reader's partition gets small files up to it.
FILE_BYTES = 64 << 20
_CHUNK = 1 << 16
_BATCH_BYTES = 4 << 20


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def member(content: bytes, level: int = 6) -> bytes:
    """A gzip member with the lengths of itself and of its content in its header, where they fit there."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(content)) >> 32:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(content))
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


class _Plain:
    """The content of one uncompressed record, read as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.at, self.got = file, at, b""

    def upto(self, n: int) -> bytes:
        while len(self.got) < n:
            self.file.seek(self.at + len(self.got))
            more = self.file.read(max(n - len(self.got), _CHUNK))
            if not more:
                break
            self.got += more
        return self.got

    def next(self, total: int) -> tuple[int, bool]:
        """Where the record after one of that many bytes begins, and whether it is in this source."""
        return self.at + total, False


class _Member:
    """The content of one gzip member, inflated as far as asked, from the record that is read next."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        head = file.read(12)
        flags, skip, self.size, self.content = head[3], 10, 0, 0
        if flags & 4:
            n = struct.unpack("<H", head[10:12])[0]
            extra, skip = file.read(n), 12 + n
            while len(extra) >= 4:
                kind, size = struct.unpack("<2sH", extra[:4])
                if kind == b"sl" and size == 8:
                    self.size, self.content = struct.unpack("<II", extra[4:12])
                extra = extra[4 + size :]
        file.seek(at + skip)
        for flag in (8, 16):  # a file name, a comment
            if flags & flag:
                while file.read(1) not in (b"\0", b""):
                    skip += 1
                skip += 1
        skip += 2 if flags & 2 else 0
        self.next_in, self.inflate, self.got, self.rest = at + skip, zlib.decompressobj(-15), [], b""
        self.n = 0

    def _more(self, want: int) -> bool:
        if self.inflate.eof:
            return False
        if not self.rest:
            self.file.seek(self.next_in)
            self.rest = self.file.read(min(_CHUNK, self.size - (self.next_in - self.at)) if self.size else _CHUNK)
            self.next_in += len(self.rest)
            if not self.rest:
                return False
        piece = self.inflate.decompress(self.rest, want)
        self.rest = self.inflate.unconsumed_tail
        self.got.append(piece)
        self.n += len(piece)
        return True

    def upto(self, n: int) -> bytes:
        while self.n < n and self._more(max(n - self.n, 4096)):
            pass
        self.got = [b"".join(self.got)]
        return self.got[0]

    def drop(self, n: int) -> None:
        """Leaves n bytes out."""
        while n > 0:
            held = self.upto(min(n, 1 << 20))
            k = min(n, len(held))
            if not k:
                return
            self.got, self.n, n = [held[k:]], self.n - k, n - k

    def next(self, total: int) -> tuple[int, bool]:
        """Where the record after one of that many bytes begins: here, if the member has more than that, else beyond the member."""
        if self.size and self.content <= total:
            return self.at + self.size, False
        self.drop(total)
        if self.more():
            return self.at, True
        return self.next_in - len(self.inflate.unused_data) + 8, False

    def more(self) -> bool:
        """Whether the member goes on after blank lines, which are left out."""
        while held := self.upto(1)[:1]:
            if held not in b"\r\n":
                return True
            self.drop(1)
        return False


def records(file, wanted=lambda headers: True, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The headers and payload of the records that are wanted, in the file's order.

    The payload of an HTTP response is its body, that of other records their block.
    """
    at, total, within = 0, file.size(), False
    while within or at < total:
        if not within:
            file.seek(at)
            start = file.read(2)
            if start != b"\x1f\x8b" and start.strip() == b"":  # blank lines between records
                at += 2
                continue
            source = _Member(file, at) if start == b"\x1f\x8b" else _Plain(file, at)
            if isinstance(source, _Member) and not source.more():
                at, _ = source.next(0)
                continue
        if source.upto(5)[:5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        n, end = 2048, -1
        while end < 0:
            text = source.upto(n)
            end = text.find(b"\r\n\r\n")
            if end < 0 and len(text) < n:
                raise ValueError(f"a WARC record at byte {at} has no end of headers")
            n *= 2
        headers = _headers(text[:end])
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            block = source.upto(end + 4 + length)[end + 4 : end + 4 + length] if payloads else None
            if block is not None and headers.get("content-type", "").replace(" ", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield headers, block
        at, within = source.next(end + 4 + length + 4)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.tests = schema.names, options["path"], []

    def pushFilters(self, filters):
        for f in filters:
            kind, name = type(f).__name__, getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            if len(name) == 1 and name[0] in FIELDS and kind in ("EqualTo", "In", "StringStartsWith", "IsNotNull", "IsNull"):
                self.tests.append((kind, FIELDS[name[0]], tuple(value) if kind == "In" else value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = _filesystem(self.path)
        there = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = sorted((f.path, f.size) for f in there if f.type == fs.FileType.File and f.base_name[0] not in "._")
        out, held, size = [], [], 0
        for p, n in files:
            if held and size + n > FILE_BYTES:
                out.append(_Files(tuple(held)))
                held, size = [], 0
            held.append(p)
            size += n
        return [*out, _Files(tuple(held))] if held else out or [_Files(())]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, header, value in self.tests:
            found = headers.get(header)
            if kind == "IsNull":
                if found is not None:
                    return False
            elif found is None or kind == "EqualTo" and found != value or kind == "In" and found not in value or kind == "StringStartsWith" and not found.startswith(value):
                return False
        return True

    def read(self, partition):
        system, _ = _filesystem(self.path)
        kinds = {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, block in records(file, self.wanted, "payload" in self.names):
                    row = {k: headers.get(h) for k, h in FIELDS.items()}
                    row |= {"content_length": int(headers.get("content-length", 0)), "headers": list(headers.items()), "payload": block}
                    rows.append({n: row[n] for n in self.names})
                    size += len(block or b"") + 500
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of type, record_id, target_uri, date, headers (further ones) and payload.

    A response's payload becomes the body of an HTTP response.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{part:05d}-{len(files):04d}-{self.job}.warc.gz"
                    files.append((f"{path}/_{attempt}-{name}", f"{path}/{name}"))
                    out, size = system.open_output_stream(files[-1][0], compression=None), 0
                headers = [("WARC-Type", row["type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"])]
                headers += [("WARC-Target-URI", row["target_uri"])] if row["target_uri"] is not None else []
                headers += [(k, v) for k, v in row["headers"] or () if v is not None]
                block = row["payload"] or b""
                if row["type"] == "response":
                    headers.append(("Content-Type", "application/http;msgtype=response"))
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(block) + block
                data = member(record(headers, block))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(tuple(files))

    def commit(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            for hidden, final in m.files if m else ():
                system.move(hidden, final)

    def abort(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            for hidden, _final in m.files if m else ():
                system.delete_file(hidden)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("warc files are appended; remove the folder to write it anew")
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records below path. Leave payload out of the schema to have none decoded."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).load(path)


def write_warc(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").mode("append").save(path)


#: Payloads below this are stored each; groups of equal payloads up to which their table is broadcast (about 60 bytes each).
REVISIT_BYTES, BROADCAST_GROUPS = 1000, 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def archive_pages(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Writes page_id, url, html as WARC records below path, equal payloads of least bytes or more once.

    The largest page_id of equal payloads is the response, the others are revisits of it; rows with that same page_id
    are responses too. A null html is an empty payload, a null url has no target URI, and a null page_id is always
    a response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = keyed.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").checkpoint()
    few = groups.count() <= BROADCAST_GROUPS
    keyed = keyed.join(F.broadcast(groups) if few else groups, "digest", "left")
    revisit = F.coalesce((F.octet_length("payload") >= least) & (F.col("page_id") != F.col("first_id")), F.lit(False))
    name = lambda c: F.format_string("<urn:page:%s>", F.coalesce(c.cast("string"), F.concat(F.lit("null-"), F.col("digest"))))
    extra = {
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"),
        "X-Payload-Length": F.octet_length("payload").cast("string"),
        "WARC-Profile": F.when(revisit, F.lit(PROFILE)),
        "WARC-Refers-To": F.when(revisit, name(F.col("first_id"))),
    }
    write_warc(
        keyed.select(
            F.when(revisit, "revisit").otherwise("response").alias("type"),
            name(F.col("page_id")).alias("record_id"),
            F.col("url").alias("target_uri"),
            F.lit("2024-01-01T00:00:00Z").alias("date"),
            F.create_map(*(x for k, v in extra.items() for x in (F.lit(k), v))).alias("headers"),
            F.when(~revisit, F.col("payload")).alias("payload"),
        ),
        path,
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back. The digest and length of responses are those of the payload that was read."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    back = read_warc(spark, path).where(F.col("type").isin("response", "revisit"))
    response = F.col("type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("headers")["x-payload-length"]).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("headers")["warc-refers-to"]).alias("refers_to"),
    )


ORACLE_OP8 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to FROM q
"""
