"""Legacy ARC archives: parsing, conversion to WARC, writing and reading WARC.

An ARC file opens with a ``filedesc:`` record whose body names the version and the
fields of every later header line; each record is such a line, then as many bytes
as its last field declares. The converter takes the fields by the names of the
version at hand (URLs may hold spaces, so lines are split from the right), and
makes of each record what WARC needs: a UUID from the SHA-256 of its archive's name,
its offset there, URL, date and body, an ISO timestamp from the 14-digit date, the type from the scheme and
body, and block and payload digests.

Archives go through Spark's own writers and readers, so they may lie in any store
that Spark reaches: a record's bytes are a row of the text sink, whose line end is
the record's last LF, and files come back through ``binaryFile``. Files are gzipped;
their size follows the partitions they were written from. An archive is unpacked as a
stream, so a task holds its packed bytes and one record, not its contents.

Archives are read twice: once for an index without bodies, from which repeated payloads
are told, once to write each archive's records. Bodies are never shuffled; what the
second reading needs to know is a list an archive.

Defined results: a null payload is empty; a null URL is written ``-`` and has no
target; a declared length beyond the end of the file marks the record truncated and
ends the file; a header line that does not fit its version is an error; of pages
equal in every respect one is the response; no pages give empty archives.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.operators.sizes import BROADCAST_ROWS

from .scratch import cut, forget, new_path, remove

#: The header fields of each ARC version, as its filedesc body names them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SAFE = re.compile(rb"[\x00-\x20\x7f]")
_ROWS = 200
_BATCH_BYTES = 8 << 20
_PIECE = 1 << 20  # read at once; no header line is longer


def _encoded(url: str | None) -> bytes:
    return _SAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()) if url else b"-"


def arc_record(version: int, url: str | None, ip: str, date: str, body: bytes, offset: int = 0, mime: str = "text/html") -> bytes:
    head = [_encoded(url), ip.encode(), date.encode(), mime.encode()]
    if version == 2:
        head += [b"200", hashlib.sha1(body).hexdigest().encode(), b"-", b"%d" % offset, b"pages.arc"]
    return b" ".join([*head, b"%d" % len(body)]) + b"\n" + body


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 pitwise\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, body, mime="text/plain")


class _Unzipped(io.RawIOBase):
    """What the gzip members of a file hold, unpacked as it is read; a member cut short ends it."""

    def __init__(self, packed):
        self._packed, self._member, self._rest = packed, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if len(self._rest) < 2:
                self._rest += self._packed.read(1 << 16)
            if self._member is None:
                if self._rest[:2] != b"\x1f\x8b":
                    return 0
                self._member = zlib.decompressobj(31)
            had = len(self._rest)
            out = self._member.decompress(self._rest, len(into))
            self._rest = self._member.unconsumed_tail
            if self._member.eof:
                self._rest, self._member = self._member.unused_data, None
            into[: len(out)] = out
            if out or not had:
                return len(out)


def opened(data: bytes | pa.Buffer) -> io.BufferedReader:
    """An archive as a stream, unpacked if it is gzipped."""
    packed = pa.BufferReader(data)
    zipped = packed.read(2) == b"\x1f\x8b"
    packed.seek(0)
    return io.BufferedReader(_Unzipped(packed) if zipped else packed, 1 << 16)


def _taken(stream: io.BufferedReader, size: int) -> bytes:
    """The next ``size`` bytes, or what there is of them, whatever size is declared."""
    parts = []
    while size > 0 and (part := stream.read(min(size, _PIECE))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def arc_records(data: bytes | pa.Buffer, name: str = "") -> Iterator[dict]:
    """The records of one archive, the filedesc included: a dict of the version's
    fields, with ``version``, ``body``, ``truncated``, ``archive`` (as the filedesc
    names it) and ``offset``."""
    stream = opened(data)
    at, version, fields, archive = 0, None, ARC_FIELDS[1].split(), name
    while whole := stream.readline(_PIECE):
        line = whole.lstrip(b"\r\n")
        at += len(whole) - len(line)
        if not line:
            continue
        ended, size, line = line.endswith(b"\n"), len(line), line.rstrip(b"\r\n")
        if version is None and line.startswith(b"filedesc:"):  # its line has the fields that its own body names
            first = stream.peek(1)[:1]
            fields = ARC_FIELDS.get(int(first) if first.isdigit() else 0, ARC_FIELDS[1]).split()
        values = line.rsplit(b" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit() or not ended:
            raise ValueError(f"{name or 'archive'}: no header line of version {version or 1} at byte {at}: {line[:80]!r}")
        length = int(values[-1])
        body = _taken(stream, length)
        record = dict(zip([f.lower() for f in fields], (v.decode("utf-8", "replace") for v in values)))
        if version is None:
            version = 1
            if line.startswith(b"filedesc:"):
                archive = record["url"]
                head = body.split(b"\n")
                version = int(head[0].split(b" ")[0])
                fields = head[1].decode().split() if len(head) > 1 and head[1] else ARC_FIELDS[version].split()
        yield record | {"version": version, "body": body, "truncated": len(body) < length, "archive": archive, "offset": at}
        at += size + length


def split_http(body: bytes) -> int | None:
    """Where the payload of an HTTP response begins; None if it is no response."""
    if not body.startswith(b"HTTP/"):
        return None
    found = [(i, n) for i, n in ((body.find(b"\r\n\r\n"), 4), (body.find(b"\n\n"), 2)) if i >= 0]
    i, n = min(found, default=(len(body), 0))
    return i + n


def http_header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def iso_date(date: str) -> str:
    """14 digits (or a prefix of 4 to 12 of them) as an ISO timestamp."""
    d = (date + "00000101000000"[len(date) :]) if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(record: dict) -> dict:
    """What a WARC record needs of an ARC record."""
    url, body = record["url"], record["body"]
    at = split_http(body)
    kind, mime = "resource", record["content-type"]
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        body = f"software: pitwise\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {record['version']}\r\n".encode()
    elif url.startswith("dns:"):
        mime = "text/dns"
    elif at is not None:
        kind, mime = "response", "application/http; msgtype=response"
    payload = body[at:] if kind == "response" else body
    block = hashlib.sha256(body).hexdigest()
    named = hashlib.sha256("\n".join([record["archive"], str(record["offset"]), url, record["archive-date"], block]).encode()).digest()
    return {
        "arc_version": record["version"],
        "record_id": f"<urn:uuid:{uuid.UUID(bytes=named[:16], version=5)}>",
        "type": kind,
        "date": iso_date(record["archive-date"]),
        "uri": None if url == "-" or kind == "warcinfo" else url,
        "ip": record["ip-address"],
        "mime": mime,
        "truncated": record["truncated"],
        "block": body,
        "head_bytes": at if kind == "response" else 0,
        "block_digest": block,
        "payload_digest": hashlib.sha256(payload).hexdigest(),
        "payload_bytes": len(payload),
    }


_CONVERTED = (
    "arc_version int, record_id string, type string, date string, uri string, ip string, mime string, truncated boolean, block binary, "
    "head_bytes int, block_digest string, payload_digest string, payload_bytes long, sort_key long, path string"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batched(rows: Iterator[dict], schema: pa.Schema, body: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[body] or b"")
        if len(held) == _ROWS or size > _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``path``, packed bytes (not copied) and the other columns of each file."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, content, *more = (batch.column(c)[i] for c in range(batch.num_columns))
            yield path.as_py(), content.as_buffer(), *(m.as_py() for m in more)


def read_arc(spark: SparkSession, path: str, sort_header: str = "X-Page-Id", with_blocks: bool = True) -> DataFrame:
    """All records of the ARC archives at ``path``, converted; ``sort_key`` is the
    integer in the HTTP header ``sort_header``, if it holds one; ``path`` is the archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, content in _archives(batches):
                for record in arc_records(content, name):
                    out = converted(record)
                    key = http_header(out["block"][: out["head_bytes"]], sort_header)
                    yield out | {"sort_key": int(key) if key and key.lstrip("-").isdigit() else None, "path": name, "block": out["block"] if with_blocks else None}

        yield from _batched(rows(), arrow_schema(_CONVERTED), "block")

    return _files(spark, path).mapInArrow(run, _CONVERTED)


def revisits(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Of the responses with equal payloads of ``min_bytes`` or more, all but the first
    in ``(sort_key, record_id)`` (nulls last): ``path, record_id`` and the first one's
    ``refers_to_id, refers_to_uri, refers_to_date``. ``records`` is read more than once."""
    able = records.filter((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    order = F.struct(F.col("sort_key").isNull().alias("no_key"), "sort_key", "record_id", "uri", "date")  # ids differ
    first = able.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = able.join(first, "payload_digest").filter(F.col("first.record_id") != F.col("record_id"))
    return later.select("path", "record_id", F.col("first.record_id").alias("refers_to_id"), F.col("first.uri").alias("refers_to_uri"), F.col("first.date").alias("refers_to_date"))


def warc_record(r: dict) -> bytes:
    block = r["block"]
    head = [("WARC-Type", r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"])]
    if r["uri"]:
        head.append(("WARC-Target-URI", r["uri"]))
    if r["type"] != "warcinfo":
        head.append(("WARC-IP-Address", r["ip"]))
        head.append(("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"))
    if r["type"] == "revisit":
        block = block[: r["head_bytes"]]
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", r["refers_to_id"]), ("WARC-Refers-To-Date", r["refers_to_date"])]
        if r["refers_to_uri"]:
            head.append(("WARC-Refers-To-Target-URI", r["refers_to_uri"]))
        digest = hashlib.sha256(block).hexdigest()
    else:
        digest = r["block_digest"]
    if r["truncated"]:
        head.append(("WARC-Truncated", "unspecified"))
    head += [("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Type", r["mime"]), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _write_bytes(rows: DataFrame, path: str, level: str) -> None:
    """Rows of bytes, each followed by LF, in gzipped files below ``path``."""
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", level).text(path)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, sort_header: str = "X-Page-Id", min_bytes: int = 100) -> None:
    """Convert the ARC archives at ``arc`` into WARC archives at ``warc``, with revisit
    records for repeated payloads (see ``revisits``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, content, later in _archives(batches):
                later = {r["record_id"]: r | {"type": "revisit"} for r in later or ()}
                for record in arc_records(content, name):
                    out = converted(record)
                    yield {"value": warc_record(out | later.get(out["record_id"], {}))[:-1]}

        yield from _batched(rows(), arrow_schema("value binary"), "value")

    index = cut(read_arc(spark, arc, sort_header, with_blocks=False).select("path", "record_id", "type", "uri", "date", "payload_digest", "payload_bytes", "sort_key"), "arc-index")
    later = cut(revisits(index, min_bytes), "revisits")
    lists = later.groupBy("path").agg(F.collect_list(F.struct("record_id", "refers_to_id", "refers_to_uri", "refers_to_date")).alias("later"))  # no longer than an archive
    lists = F.broadcast(lists) if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lists.hint("merge")
    _write_bytes(_files(spark, arc).join(lists, "path", "left").select("path", "content", "later").mapInArrow(run, "value binary"), warc, "THREE")
    forget(index, later)


def _write_bytes(rows: DataFrame, path: str, level: str) -> None:
    """Rows of bytes, each followed by LF, in gzipped files below ``path``."""
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", level).text(path)


def warc_records(data: bytes | pa.Buffer, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of one archive."""
    stream, at = opened(data), 0
    while line := stream.readline(_PIECE):
        start, head, size = line, {}, len(line)
        while (line := stream.readline(_PIECE)) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            head[key.lower()] = value
            size += len(line)
        if not start.startswith(b"WARC/") or not line:
            raise ValueError(f"{name or 'archive'}: no WARC record at byte {at}")
        length = int(head["content-length"])
        yield head, _taken(stream, length)
        at += size + 2 + length + len(stream.read(4))


_READ = (
    "record_id string, record_type string, uri string, date string, http_head string, payload binary, payload_bytes long, "
    "payload_digest string, refers_to_id string"
)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Response, resource and revisit records of the archives at ``path``. Block
    digests are verified. ``payload_bytes`` and ``payload_digest`` are those of the
    full payload, for revisits as their headers state them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, content in _archives(batches):
                for head, block in warc_records(content, name):
                    if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["warc-block-digest"]:
                        raise ValueError(f"record {head['warc-record-id']} is damaged")
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    at = split_http(block) or 0
                    stated = head.get("warc-payload-digest", ":").split(":", 1)[1]
                    size = http_header(block[:at], "Content-Length") if kind == "revisit" else None
                    yield {
                        "record_id": head["warc-record-id"], "record_type": kind, "uri": head.get("warc-target-uri"), "date": head["warc-date"],
                        "http_head": block[:at].decode("utf-8", "replace"), "payload": block[at:] if with_payload else None,
                        "payload_bytes": int(size) if size else len(block) - at,
                        "payload_digest": stated if kind == "revisit" else hashlib.sha256(block[at:]).hexdigest(), "refers_to_id": head.get("warc-refers-to"),
                    }

        yield from _batched(rows(), arrow_schema(_READ), "payload")

    return _files(spark, path).mapInArrow(run, _READ)


def write_pages_as_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> None:
    """Write pages as ARC archives, files of even partitions in version 1, of odd
    ones in version 2. The page's id travels in the HTTP header ``X-Page-Id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, offset = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                values = []
                for page, url, html, part in zip(*(batch.column(i).slice(lo, _ROWS).to_pylist() for i in range(4))):
                    if version is None:
                        version = 1 + part % 2
                        values.append(arc_filedesc(version, f"pages-{part:05d}.arc", date))
                    payload = (html or "").encode()
                    name = "" if page is None else str(page)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {name}\r\n\r\n"
                    values.append(arc_record(version, url, "192.0.2.1", date, head.encode() + payload, offset))
                    offset += len(values[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    rows = pages.select(id_col, url_col, html_col).withColumn("__part", F.spark_partition_id())
    _write_bytes(rows.mapInArrow(run, "value binary"), path, "BEST_SPEED")


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back: a row a page with
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_pages_as_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    remove(spark, arc)
    found = read_warc(spark, warc, with_payload=False)
    found = found.withColumn("page_id", F.expr(r"try_cast(regexp_extract(http_head, '(?m)^X-Page-Id: (-?\\d+)', 1) as long)"))
    targets = found.filter("record_type = 'response'").select(F.col("record_id").alias("__target"), F.col("page_id").alias("refers_to"))
    return found.join(targets, F.col("refers_to_id") == F.col("__target"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"
    )
