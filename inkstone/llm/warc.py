"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records,
and at its end a seek table in a skippable frame (the public seekable format), so any
frame can be found and decompressed alone.  The index maps each record identifier to its
bundle, its frame, and its place in the decompressed frame.

Records with equal payloads are written once, as response; the others are revisit records
that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Uncompressed bytes from which a frame is closed, and compressed bytes from which a bundle is.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 64 << 20, 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format and of WARC 1.1.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "page_id long, record_id string, record_type string, refers_to long, bundle string, frame int, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, copy: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}/{copy}')}>"


def _header(value: str) -> str:
    return urllib.parse.quote(value, safe="".join(map(chr, range(33, 127))))


def warc_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str, name: str, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """(WARC headers, HTTP header, body, end) of the record at ``at``."""
    head = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:head].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start, end = head + 4, head + 4 + int(headers["Content-Length"])
    split = data.index(b"\r\n\r\n", start, end) + 4
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return headers, data[start:split], data[split:end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable footer for (compressed, decompressed) frame sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame of an open, seekable bundle."""
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - count * width)
    table, at, out = source.read(count * width), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Bundle:
    """Writes one bundle; rows of the index come out as frames close."""

    def __init__(self, folder: str):
        import zstandard

        self.fs, path = _file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"  # an attempt's own: a repeated task never meets its file
        self.file = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.rows: list[tuple] = []
        self.size = self.plain = 0

    def add(self, record: bytes, row: tuple) -> list[tuple]:
        self.rows.append((*row, self.name, len(self.frames), self.plain, len(record)))
        self.waiting.append(record)
        self.plain += len(record)
        return self.flush() if self.plain >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if self.waiting:
            frame = self.packer.compress(b"".join(self.waiting))
            self.file.write(frame)
            self.frames.append((len(frame), self.plain))
            self.size += len(frame)
        rows, self.rows, self.waiting, self.plain = self.rows, [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _writer(folder: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for page_id, url, html, digest, kind, refers_to, copy in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to", "copy"))):
                bundle = bundle or _Bundle(folder)
                name = record_id(page_id, copy)
                payload = (html or "").encode()
                encoded = base64.b32encode(bytes.fromhex(digest)).decode()
                rows += bundle.add(warc_record(page_id, url, payload, kind, refers_to, encoded, name), (page_id, name, kind, refers_to))
                if bundle.size >= BUNDLE_BYTES:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield _index_batch(rows)
                rows = []
        if bundle and (rows := bundle.close()):
            yield _index_batch(rows)

    return of


def write(spark: SparkSession, pages: DataFrame, *, folder: str | None = None, min_bytes: int = 0, parts: int | None = None) -> tuple[DataFrame, str]:
    """Write a record per row of pages (page_id, url, html); return (index, folder of the bundles).

    Payload: the html in UTF-8, a null html being empty.  Of records with equal payloads of
    at least ``min_bytes`` bytes, that with the largest page_id is the response and the
    others revisit it; smaller payloads are all responses.  Rows that repeat that page_id
    and payload: the first by url is the response.  A null page_id counts as smallest.
    Other columns are ignored; an empty table gives an empty index and no bundles.
    """
    work = Workspace(spark, "warc")
    folder = folder or work.path("bundles")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    sized = rows.select("page_id", "digest", F.octet_length("html").alias("bytes")).filter(F.col("bytes") >= min_bytes)
    copies = sized.groupBy("digest", "page_id").count()
    groups = copies.groupBy("digest").agg(F.sum("count").alias("n"), F.max(F.struct("page_id", "count")).alias("last")).filter("n > 1")
    groups = work.save(groups.select("digest", F.col("last.page_id").alias("last_id"), F.col("last.count").alias("last_copies"), F.lit(True).alias("shared")), "groups")

    joined = rows.join(groups, "digest", "left")
    newest = F.col("page_id").eqNullSafe(F.col("last_id"))
    copy = F.lit(1)
    if not groups.filter("last_copies > 1").isEmpty():
        repeated = F.coalesce("shared", F.lit(False)) & newest & (F.col("last_copies") > 1)
        joined = joined.withColumn("tie", F.when(repeated, F.col("digest")).otherwise(F.xxhash64("page_id", "url", "digest").cast("string")))
        joined = joined.withColumn("rank", F.row_number().over(Window.partitionBy("tie").orderBy("url")))
        copy = F.when(repeated, F.col("rank")).otherwise(1)
    response = F.col("shared").isNull() | (newest & (copy == 1))
    marked = joined.select(
        "page_id", "url", "html", "digest", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("last_id")).alias("refers_to"), copy.cast("int").alias("copy")
    )
    if parts:
        marked = marked.repartition(parts)
    index = work.save(marked.mapInArrow(_writer(folder), INDEX), "index")
    return index, folder


def _opened(fs, path: str):
    source = fs.open_input_file(path)
    return source, read_seek_table(source)


def _reader(folder: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _file_system(folder)
        unpacker = zstandard.ZstdDecompressor()
        name = source = table = frame = plain = None
        for batch in batches:
            out = []
            for bundle, number, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if source is not None:
                        source.close()
                    source, table = _opened(fs, f"{root}/{bundle}")
                    name, frame = bundle, None
                if number != frame:
                    start, packed, size = table[number]
                    source.seek(start)
                    plain, frame = unpacker.decompress(source.read(packed), max_output_size=size), number
                headers, http, body, end = parse_record(plain, offset)
                if end - offset != length:
                    raise ValueError(f"{bundle}: the record at {number}:{offset} has {end - offset} bytes, not {length}")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                stated = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                if headers["WARC-Type"] == "response" and (len(body) != stated or payload_digest(body) != digest):
                    raise ValueError(f"{bundle}: the payload at {number}:{offset} does not match its digest")
                page, refers = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id", "")
                payload = body.decode() if headers["WARC-Type"] == "response" else None
                out.append((int(page) if page else None, urllib.parse.unquote(headers["WARC-Target-URI"]), stated, digest, headers["WARC-Type"], int(refers) if refers else None, payload))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return of


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read records through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload is null for revisits; bytes and digest are always those of the full payload,
    and every response is checked against them.  Each frame is decompressed once, and there
    are as many tasks as bundles, whose size is bounded.  The index has no nulls but in
    page_id and refers_to; an empty one gives an empty result, and a record that does not
    match its index row or digest is an error.
    """
    bundles = max(1, index.select("bundle").distinct().count())
    places = index.select("bundle", "frame", "offset", "length").repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return places.mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
