"""WARC archives as a PySpark Python data source, "warc".

Reading: one partition for each archive file. Predicates on the record type and other header columns are pushed down into
the reader; a record's header is parsed first, and the payload of a record that fails them, or any payload if the option
"payload" is "false", is never inflated or decoded: the archives written here give each gzip member's length in its
header (the "sl" extra field that the WARC standard describes), so that the reader seeks past the rest. Members without
it are inflated, and plain .warc files are skipped by Content-Length.

Writing: each task writes files of its own under a name that no other attempt uses, rolled at "max_bytes"; the driver lists
those of the attempts that succeeded in a manifest of each write, which is what readers go by, so that a lost executor leaves no record
twice. Files are reached through pyarrow's file systems (file:, hdfs:, s3a:, gs:).

Defined cases: a null payload is empty; a null url leaves the target header out; a null page_id comes below all others
and reads back as null; repeated rows are records of their own, and of equal largest page_ids each is a response; an
empty table writes archives without records and reads back as an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import cut, staged_path, text_or_empty

MANIFEST = "_MANIFEST"  # and a name of its own for each write
READ = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length bigint, headers map<string,string>, payload binary"
WRITE = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload binary"
_COLUMNS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_BLOCK = 1 << 20


def files(path: str):
    """pyarrow's file system for a path or URI, and the path within it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, date: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit keeps the HTTP header, with the full payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date or '1970-01-01T00:00:00Z'}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field "sl" has its own length and that of the data (0: too long to say)."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(data) + coder.flush()
    size = 24 + len(body) + 8
    sizes = struct.pack("<II", size, len(data)) if max(size, len(data)) < 1 << 32 else bytes(8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + sizes + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Plain:
    """A stretch of plain bytes read forward, with seeks where they are cheap."""

    def __init__(self, file) -> None:
        self.file, self.at, self.held = file, 0, b""

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.file.read(max(_BLOCK, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.fill(len(self.held) + 1):
                return None
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise EOFError("an archive ends within a record")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(n - len(self.held), 1)
            self.held = b""


def _plain_records(file, wanted, payloads: bool):
    source = _Plain(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        h = _headers(head)
        length = int(h.get("content-length", 0))
        if not wanted(h):
            source.skip(length)
        else:
            yield h, source.take(length)


def _gzip_records(file, wanted, payloads: bool):
    source = _Plain(file)
    while source.fill(18):
        start = source.held
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        size, extra = 0, 0
        if start[3] & 4:
            extra = struct.unpack_from("<H", start, 10)[0]
            source.fill(12 + extra)
            if extra >= 12 and source.held[12:14] == b"sl":
                size = struct.unpack_from("<I", source.held, 16)[0]
        if size and start[3] == 4:
            first = 12 + extra
            source.fill(min(size, 1 << 14))
            coder = zlib.decompressobj(-15)
            head = coder.decompress(source.held[first : min(size, 1 << 14)], 1 << 13)
            k = head.find(b"\r\n\r\n")
            h = _headers(head[:k]) if k >= 0 else None
            if h is not None and not wanted(h):
                source.skip(size)
                continue
            if h is not None and not payloads:
                j = head.find(b"\r\n\r\n", k + 4)
                if j >= 0:
                    source.skip(size)
                    yield h, head[k + 4 : j + 4]
                    continue
            data = zlib.decompress(source.take(size)[first:-8], -15)
        else:
            coder, chunks = zlib.decompressobj(31), []
            while not coder.eof:
                if not source.held and not source.fill(1):
                    raise EOFError("an archive ends within a member")
                chunks.append(coder.decompress(source.held))
                source.held = coder.unused_data
            data = b"".join(chunks)
        head, _, rest = data.partition(b"\r\n\r\n")
        h = _headers(head)
        if wanted(h):
            yield h, rest[: int(h.get("content-length", len(rest)))]


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        how = str(options.get("payload", "true")).lower()
        self.payloads, self.verify = how != "false", how == "verify"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = _COLUMNS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.filters.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.filters.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.filters.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.filters.append((name, "has", None))
            else:
                yield f

    def wanted(self, h: dict[str, str]) -> bool:
        for name, how, value in self.filters:
            got = _clean(name, h.get(name))
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = files(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [_File(self.path)]
        lists = [x for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json")]
        if lists:
            names: set[str] = set()
            for x in lists:
                with store.open_input_stream(x.path) as f:
                    names.update(json.loads(f.read()))
            return [_File(f"{self.path}/{x}") for x in sorted(names)]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(self.path + x.path[len(path) :]) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, path = files(partition.path)
        with store.open_input_file(path) as file:
            rows, size = [], 0
            for h, block in (_gzip_records if path.endswith(".gz") else _plain_records)(file, self.wanted, self.payloads):
                rows.append(self.row(h, block))
                size += len(block)
                if len(rows) >= 1000 or size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def row(self, h: dict[str, str], block: bytes) -> tuple:
        payload, length = block, len(block)
        if h.get("content-type", "").startswith("application/http"):
            head, mark, payload = block.partition(b"\r\n\r\n")
            http = _headers(head)
            length = int(http["content-length"]) if "content-length" in http else len(payload)
        if h.get("warc-type") == "revisit" or not self.payloads:
            payload = None
        elif self.verify:
            length, digest = len(payload), h.get("warc-payload-digest")
            if digest is not None and digest != f"sha1:{base32_sha1(payload)}":
                raise ValueError(f"the payload of {h.get('warc-record-id')} differs from its digest")
            payload = None
        return (*(_clean(x, h.get(x)) for x in _COLUMNS.values()), length, list(h.items()), payload)


def _clean(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("warc-record-id", "warc-refers-to") and value[:1] == "<" and value[-1:] == ">":
        return value[1:-1]
    return value.removeprefix("sha1:") if name == "warc-payload-digest" else value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [*_COLUMNS, "payload_length", "headers", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


@dataclass
class _Wrote(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("max_bytes", 256 << 20))
        store, path = files(self.path)
        store.create_dir(path, recursive=True)

    def write(self, iterator) -> _Wrote:
        store, path = files(self.path)
        store.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for kind, record_id, uri, date, refers_to, payload in iterator:
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = member(record(kind, record_id, uri, date, refers_to, bytes(payload or b"")))
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Wrote(names)

    def commit(self, messages) -> None:
        store, path = files(self.path)
        with store.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m is not None for x in m.names)).encode())

    def abort(self, messages) -> None:
        store, path = files(self.path)
        for m in messages:
            for x in m.names if m is not None else ():
                store.delete_file(f"{path}/{x}")


class WarcSource(DataSource):
    """format("warc"): options path, max_bytes, and payload: "true", "false" or "verify" (read and held against its digest,
    of its own length, but not returned)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: str = "true") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def write_warc(df: DataFrame, path: str) -> None:
    """df: the columns of WRITE."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").save(path)


def with_revisits(pages: DataFrame, page: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """The columns of WRITE. Of records with equal payloads (by SHA-1 and length) of at least `least` bytes, that with the
    largest page is the response, and the others revisit it."""
    rows = pages.select(
        F.col(page).cast("long").alias("__page"), F.col(url).cast("string").alias("target_uri"), text_or_empty(html).cast("binary").alias("payload")
    ).withColumns({"__sha": F.sha1("payload"), "__size": F.octet_length("payload")})
    last = cut(
        rows.filter(F.col("__size") >= least).groupBy("__sha", "__size")
        .agg(F.max("__page").alias("__last"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 AND __last IS NOT NULL").drop("__n")
    )
    revisit = F.col("__last").isNotNull() & ~F.col("__page").eqNullSafe(F.col("__last"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.concat(F.lit("none:"), F.uuid())))
    return rows.join(last, ["__sha", "__size"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("__page")).alias("record_id"), "target_uri",
        F.lit(None).cast("string").alias("warc_date"), F.when(revisit, F.concat(F.lit("urn:page:"), F.col("__last").cast("string"))).alias("refers_to"), "payload",
    )


def _page(column: str):
    found = F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1)
    return F.when(found != "", found.cast("long"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    write_warc(with_revisits(pages), path)
    responses = read_warc(spark, path, "verify").filter("warc_type = 'response'")
    revisits = read_warc(spark, path, "false").filter("warc_type = 'revisit'")
    return responses.drop("payload", "headers").unionByName(revisits.drop("payload", "headers")).select(
        _page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), _page("refers_to").alias("refers_to")
    )


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), s AS (
  SELECT page_id, octet_length(b) AS payload_bytes, upper(sha1(b)) AS h FROM p
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM s
), c AS (
  SELECT *, list_transform(range(8), lambda i: list_sum(list_transform(range(5), lambda j: (strpos('0123456789ABCDEF', substr(h, (5 * i + j + 1)::INT, 1)) - 1) * (1 << (4 * (4 - j)))))::BIGINT) AS chunks FROM w
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((chunks[(k // 4 + 1)::INT] >> ((3 - k % 4) * 5)::BIGINT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM c
"""
