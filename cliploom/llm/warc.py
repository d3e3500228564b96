"""WARC archives as a Spark data source, read and written in Python.

Each record is a gzip member of its own.  The writer notes the compressed length of the member in
the gzip header's extra field, so the reader inflates only as much of a member as the headers need
and steps over the rest.  Members without the field are read too, by inflating them.

``spark.read.format("warc")`` gives record_type, record_id, target_uri, refers_to, payload_digest,
payload_bytes, payload.  Options:

* ``payload``: ``none`` (default; null, never inflated), ``digest`` (inflated and checked against
  the header's digest, not returned) or ``full`` (returned as well).

Equality, IN and prefix predicates on record_type, record_id, target_uri, refers_to and
payload_digest are applied to the headers before anything else of the record is decoded, once
``register`` has allowed filters to be pushed down.  Spark still gets exact rows: a predicate that
isn't understood is left to Spark.  Spark 4.1 keeps one set of pushed predicates for each loaded
DataFrame: a query that filters an archive in two ways must load it twice, or both get the same rows.

``df.write.format("warc")`` takes page_id long, url, payload binary, digest, payload_bytes,
record_type, refers_to long.  A task writes files under a temporary name; the commit renames those
of successful attempts, so that a lost executor leaves nothing behind that is read.  Files are cut
at ``file_bytes`` (64 MiB), which is what read partitions are planned from.  Each begins with a
record of type warcinfo, as readers expect; rows of it are read like any others, so who wants pages
asks for their record types.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .store import fresh_path, limit_arrow_batches, written

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
INPUT = "page_id long, url string, payload binary, digest string, payload_bytes long, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"  #: pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def filesystem(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def record_name(page_id: int | None) -> str:
    """A page without an id has a name without a number."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: F.Column) -> F.Column:
    """The page_id of a record's name; null where it has none."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field SL holds its compressed and plain length."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    size = 10 + 2 + 4 + 16 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 20) + b"SL" + struct.pack("<HQQ", 16, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_of(row) -> bytes:
    payload = bytes(row["payload"] or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{row['digest']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {record_name(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def file_record(name: str) -> bytes:
    block = b"software: cliploom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, file_bytes: int) -> None:
        self.path, self.overwrite, self.file_bytes, self.job = path.rstrip("/"), overwrite, file_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/_temporary-{self.job}", recursive=True)
        files, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.append((f"{root}/_temporary-{self.job}/{name}", f"{root}/{name}"))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                    out.write(member(file_record(name)))
                data = member(record_of(row))
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out = out.close()
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(root)):
                if f.path.endswith(".warc.gz"):
                    fs.delete_file(f.path)
        for old, new in (x for m in messages if m for x in m.files):
            fs.move(old, new)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/_temporary-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary-{self.job}")


class Source:
    """Members of a file, one after the other."""

    def __init__(self, fs, path: str) -> None:
        self.file, self.size, self.at = fs.open_input_file(path), fs.get_file_info(path).size, 0

    def members(self) -> Iterator[Member]:
        while self.at < self.size:
            m = Member(self, self.at)
            yield m
            self.at += m.length()
        self.file.close()


class Member:
    FIRST = 1536  #: bytes read to begin with; enough for headers, as a rule
    NEXT = 1 << 18

    def __init__(self, source: Source, at: int) -> None:
        self.source, self.at = source, at
        raw = source.file.read_at(min(self.FIRST, source.size - at), at)
        if raw[:3] != b"\x1f\x8b\x08"[: len(raw)]:
            raise ValueError(f"no gzip member at byte {at}")
        if len(raw) < 12:  # a gzip member has 18 bytes at least
            raise ValueError(f"truncated member at byte {at}")
        self.known: int | None = None
        if raw[3] & 4:
            extra = raw[12 : 12 + struct.unpack("<H", raw[10:12])[0]]
            if extra[:4] == b"SL\x10\0":
                if len(extra) >= 12:
                    self.known = struct.unpack("<Q", extra[4:12])[0]
                if self.known is None or at + self.known > source.size:
                    raise ValueError(f"truncated member at byte {at}")
        self.inflate, self.waiting, self.read, self.plain = zlib.decompressobj(31), raw, 0, bytearray()

    def more(self) -> bool:
        """Inflate some more; False at the end."""
        if self.inflate.eof:
            return False
        if not self.waiting:
            end = self.at + self.known if self.known else self.source.size
            here = self.at + self.read
            self.waiting = self.source.file.read_at(min(self.NEXT, end - here), here)
            if not self.waiting:
                raise ValueError(f"truncated member at byte {self.at}")
        self.plain += self.inflate.decompress(self.waiting)
        self.read += len(self.waiting)
        self.waiting = b""
        return True

    def until(self, mark: bytes, start: int) -> int:
        """Where ``mark`` ends, from ``start``."""
        while (k := self.plain.find(mark, start)) < 0:
            start = max(start, len(self.plain) - len(mark) + 1)
            if not self.more():
                raise ValueError(f"no end of headers in the record at byte {self.at}")
        return k + len(mark)

    def all(self) -> memoryview:
        while self.more():
            pass
        return memoryview(self.plain)

    def length(self) -> int:
        if self.known:
            return self.known
        self.all()
        return self.read - len(self.inflate.unused_data)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, split_bytes: int) -> None:
        if payload not in ("none", "digest", "full"):
            raise ValueError("payload must be none, digest or full")
        self.path, self.payload, self.split_bytes = path, payload, split_bytes
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in HEADERS and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append(("in", name, (f.value,)))
            elif name in HEADERS and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append(("in", name, tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append(("prefix", name, (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files, largest first, dealt to partitions of about ``split_bytes``."""
        from pyarrow.fs import FileSelector

        fs, root = filesystem(self.path)
        files = [f for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".warc.gz")]
        parts: list[Files] = []
        held = 0
        for f in sorted(files, key=lambda f: (-f.size, f.path)):
            if not parts or held + f.size > self.split_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(f.path)
            held += f.size
        return parts or [Files([])]

    def wanted(self, row: dict[str, str | None]) -> bool:
        for kind, name, values in self.tests:
            v = row[name]
            if v is None or (v not in values if kind == "in" else not v.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        for path in partition.paths:
            for m in Source(fs, path).members():
                end = m.until(b"\r\n\r\n", 0)
                head = fields(bytes(m.plain[:end]))
                row = {name: head.get(key) for name, key in HEADERS.items()}
                row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                if row["target_uri"] is not None:
                    row["target_uri"] = row["target_uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                if not self.wanted(row):
                    continue
                size, payload = int(head.get("content-length", 0)), None
                if (row["record_type"] or "") in ("response", "revisit"):
                    start = m.until(b"\r\n\r\n", end)
                    size = int(fields(bytes(m.plain[end:start])).get("content-length", 0))
                if self.payload != "none" and row["record_type"] == "response":
                    payload = bytes(m.all()[start : end + int(head["content-length"])])
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"] or len(payload) != size:
                        raise ValueError(f"the payload of {row['record_id']} isn't what its headers say")
                yield (*(row[c] for c in HEADERS), size, payload if self.payload == "full" else None)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "none"), int(self.options.get("split_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("file_bytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_digest(binary: str) -> F.Column:
    """SHA-1 in base 32, from the hexadecimal digest: 8 characters of 5 bits for every 10 of 4."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(4):
        n = F.conv(F.substring(binary, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(alphabet, F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for the writer: of equal payloads the row of largest id is a response, the others revisit it.

    Payloads are equal if SHA-1, MD5 and length are: of the first alone, texts made to agree are known.

    * A null html is an empty payload; empty payloads are equal payloads like any other.
    * Rows that repeat the largest id are responses too.  A null id is smaller than any other; if a
      payload has only null ids, its rows are responses.
    * A null url is left out of the record.  Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("hex", F.sha1("payload"))
    rows = rows.withColumn("same", F.concat_ws(":", "hex", F.md5("payload"), F.octet_length("payload")))
    # Only payloads that repeat; where they are few, Spark broadcasts them and no payload is shuffled.
    repeated = rows.groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = rows.join(written(repeated.select("same", "last"), "warc-last"), "same", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        "page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), base32_digest("hex").alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` as archives in a folder that all executors share; gives the folder."""
    spark = pages.sparkSession
    register(spark)
    limit_arrow_batches(spark)
    path = path or fresh_path(spark, "warc")
    plan_records(pages).write.format("warc").mode("append").option("path", path).save()
    return path
