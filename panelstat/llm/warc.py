"""WARC archives as a PySpark data source, read and written.

Reading: the driver lists files and plans one partition for each. A task parses a record's header first; if the
header fails a pushed predicate the content is skipped, by a seek in plain files. Predicates on
``record_type``, ``record_id``, ``target_uri``, ``payload_digest`` and ``refers_to`` come from the query's filters, for
which ``read_warc`` turns on the session's ``spark.sql.python.filterPushdown.enabled`` (Spark refuses a source that
pushes filters down without it), and from the options below. With option ``payload`` "false" no content is decoded at all.

Options: ``record_types`` (comma-separated), ``header.<Name>`` (a header that must have this value),
``payload`` (true/false), ``max_file_bytes`` (writing: a file is closed when it is that long, so no read partition is
much larger), ``compress`` (writing: true for .warc.gz with a gzip member for each record, false for plain files).

A member that this writer makes names its own compressed length in a gzip extra field ("sl"). Reading, a task inflates
the start of a member, which holds the record's header, and seeks over the rest of a member that no one wants.

Writing: a task writes files under a temporary name; the commit on the driver gives them their own.
Files of lost or repeated attempts keep the temporary name, which readers skip and the commit removes.

Defined cases: a null payload is an empty one; white space and control characters in header values
are percent-encoded; gzip files without the extra field are read through from the start; a truncated last record is an error.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from panelstat.session import shared_folder

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
NAMES = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MIN_REVISIT = 100
BATCH_BYTES = 4 << 20


def _safe(value: str) -> str:
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._<>\"\\^`{|}" + "".join(c for c in value if ord(c) > 160))


def record(row: dict) -> bytes:
    """One record. Response and revisit records hold an HTTP block; a revisit's has the header only."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    length = row.get("payload_length") if kind == "revisit" else len(payload)
    http = kind in ("response", "revisit")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (length or 0) if http else b""
    block += b"" if kind == "revisit" else payload
    head = {name: row.get(c) for c, name in NAMES.items()} | {"WARC-Date": DATE}
    if kind == "revisit":
        head["WARC-Profile"] = PROFILE
    head |= dict(row.get("headers") or {})
    head |= {"Content-Type": "application/http;msgtype=response" if http else "application/octet-stream", "Content-Length": str(len(block))}
    lines = [f"{k}: {_safe(str(v))}" for k, v in head.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _head(f) -> dict[str, str] | None:
    """The next record's header, or None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    for raw in iter(f.readline, b""):
        text = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return out
        if text[0] in " \t" and out:  # a folded line goes on
            last = next(reversed(out))
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        out[name.strip()] = value.strip()
    raise ValueError("truncated WARC header")


def records(f, wanted=lambda head: True, payload: bool = True, skip=None) -> Iterator[tuple[dict, int, bytes | None]]:
    """(header, payload length, payload) of the wanted records of an open file; the rest is passed over."""
    for head in iter(lambda: _head(f), None):
        low = {k.lower(): v for k, v in head.items()}
        size = int(low["content-length"])
        if not wanted(low):
            skip(size) if skip else f.read(size)
            continue
        kind = low.get("warc-type")
        http = low.get("content-type", "").startswith("application/http")
        taken, length = 0, size
        if http:  # the HTTP header tells how long the payload is
            while taken < size:
                line = f.readline()
                taken += len(line)
                if not line.endswith(b"\n"):
                    raise ValueError("truncated WARC record")
                if line in (b"\r\n", b"\n"):
                    break
                name, _, value = line.partition(b":")
                if kind == "revisit" and name.strip().lower() == b"content-length":
                    length = int(value)
            if kind != "revisit":
                length = size - taken
        body = None
        if payload and kind != "revisit":
            body = f.read(size - taken)
            if len(body) < size - taken:
                raise ValueError("truncated WARC record")
        else:
            skip(size - taken) if skip else f.read(size - taken)
        yield head, length, body


_MEMBER = "<4s6sH2sHII"  # magic, method and flags; time, level, system; extra field: length, name, length, sizes
_MEMBER_SIZE = struct.calcsize(_MEMBER)
_START = 8 << 10


def member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field says how long it is, compressed and not."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = _MEMBER_SIZE + len(body) + 8
    return struct.pack(_MEMBER, b"\x1f\x8b\x08\x04", b"\0\0\0\0\0\xff", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _gzip_records(raw, wanted, payload: bool) -> Iterator[tuple[dict, int, bytes | None]]:
    """As ``records``, of a gzip file."""
    at = 0
    while start := raw.read(_START):
        known = len(start) >= _MEMBER_SIZE and start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl"
        if not known:
            raw.seek(at)
            yield from records(io.BufferedReader(gzip.GzipFile(fileobj=raw)), wanted, payload)
            return
        size = struct.unpack_from(_MEMBER, start)[5]
        try:  # as much as the start holds
            found = list(records(io.BytesIO(zlib.decompressobj(-15).decompress(start[_MEMBER_SIZE: size - 8])), wanted, payload))
        except ValueError:
            raw.seek(at)
            found = list(records(io.BytesIO(gzip.decompress(raw.read(size))), wanted, payload))
        yield from found
        at += size
        raw.seek(at)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "/" + path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []
        self.present: list[str] = []
        if options.get("record_types"):
            self.equal.append(("warc-type", frozenset(x.strip() for x in options["record_types"].split(","))))
        self.equal += [(k[7:].lower(), frozenset([v])) for k, v in options.items() if k.lower().startswith("header.")]

    def pushFilters(self, filters):
        for f in filters:
            name = NAMES.get(f.attribute[0], "").lower() if len(getattr(f, "attribute", ())) == 1 else ""
            if name and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.equal.append((name, frozenset([f.value])))
            elif name and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.equal.append((name, frozenset(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.prefix.append((name, f.value))
            elif name and isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self):
        where, path = _place(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True)) if where.get_file_info(path).type == fs.FileType.Directory else [where.get_file_info(path)]
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "._"]

    def wanted(self, head: dict[str, str]) -> bool:
        return all(head.get(k) in v for k, v in self.equal) and all(head.get(k, "").startswith(v) for k, v in self.prefix) and all(k in head for k in self.present)

    def read(self, partition):
        if partition is None or not getattr(partition, "path", None):  # an archive without files
            return
        where, _ = _place(self.path)
        with where.open_input_file(partition.path) as raw:
            if partition.path.endswith(".gz"):
                yield from _batches(_gzip_records(raw, self.wanted, self.payload))
                return
            f = io.BufferedReader(raw, 1 << 16)
            yield from _batches(records(f, self.wanted, self.payload, lambda n: f.seek(n, 1)))


def _batches(found: Iterator[tuple[dict, int, bytes | None]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string()) for c in NAMES] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
    rows, size = [], 0

    def batch():
        cols = [[h.get(n) for h, _, _ in rows] for n in NAMES.values()] + [[n for _, n, _ in rows], [list(h.items()) for h, _, _ in rows], [p for _, _, p in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    for x in found:
        rows.append(x)
        size += len(x[2] or b"") + 500
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.limit = int(options.get("max_file_bytes", 64 << 20))
        self.compress = options.get("compress", "true").lower() != "false"
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        where, path = _place(self.path)
        where.create_dir(path)
        paths, out = [], None
        for b in iterator:
            for row in b.to_pylist():
                if out is None:
                    paths.append(f"{path}/_{self.job}-{uuid.uuid4().hex}.warc{'.gz' * self.compress}")
                    out = where.open_output_stream(paths[-1], compression=None)
                out.write(member(record(row)) if self.compress else record(row))
                if out.tell() >= self.limit:
                    out = out.close()
        if out is not None:
            out.close()
        return _Written(paths)

    def _rest(self, keep: bool, messages) -> None:
        where, path = _place(self.path)
        where.create_dir(path)
        n = 0
        for m in messages if keep else []:
            for p in m.paths if m else []:
                where.move(p, f"{path}/part-{n:06d}-{self.job}.warc{'.gz' * self.compress}")
                n += 1
        for x in where.get_file_info(fs.FileSelector(path)):
            if x.base_name.startswith(f"_{self.job}"):
                where.delete_file(x.path)

    def commit(self, messages):
        self._rest(True, messages)

    def abort(self, messages):
        self._rest(False, messages)


class WarcDataSource(DataSource):
    """``spark.dataSource.register(WarcDataSource)``, then format("warc")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def page_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Records of pages (page_id, url, html): the smallest page_id of equal payloads responds, the others revisit it.

    Payloads under ``min_revisit`` bytes always respond, as do rows without page_id and rows that share the smallest one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = own.filter(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    own = own.join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return own.select(
        urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), F.when(revisit, urn("first_id")).alias("refers_to"),
        F.length("payload").cast("long").alias("payload_length"), F.lit(None).cast("map<string,string>").alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records_: DataFrame, path: str, **options) -> None:
    records_.sparkSession.dataSource.register(WarcDataSource)
    records_.write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, record_types: list[str] | None = None, headers: dict[str, str] | None = None, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    opts = {f"header.{k}": v for k, v in (headers or {}).items()} | ({"record_types": ",".join(record_types)} if record_types else {})
    return spark.read.format("warc").options(payload=str(payload).lower(), **opts).load(path)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives written from pages and read back."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_warc(page_records(pages, min_revisit), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    full = read_warc(spark, path).filter(F.col("record_type") == "response")
    again = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    cols = lambda df, size, digest: df.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return cols(full, F.length("payload").cast("long"), F.sha2("payload", 256)).union(cols(again, F.col("payload_length"), F.regexp_replace("payload_digest", "^sha256:", "")))
