"""WARC archives as seekable Zstandard bundles.

Each partition writes bundles in the shared folder: records grouped into independent frames, then a footer seek table in a
skippable frame (compressed and plain size of every frame). An index row maps each record to its bundle, frame and offset
within the frame. A bundle is written under a name of its own and moved into place when complete, and only bundles that
committed tasks return are in the index: a lost or repeated task leaves at most an unread file.

Of records with equal payloads of at least `revisit_from` bytes, that with the largest id is the response and the others
are revisits of it. Null payloads count as empty; null ids are responses; repeated rows are judged alike, and rows of one page and
payload share a record id. An empty table gives no bundle. Very long payloads are written and read one at a time; other columns
are not looked at. Ids may be of any type that is written as text without loss; they are percent-encoded in
headers, and come back in their own type.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.common import fresh_path, stored, text_blocks

#: Fixed values of the seekable format and of revisit records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Plain bytes of a frame and of a bundle, at which a new one starts.
FRAME, BUNDLE = 1 << 18, 1 << 28


def record_id(page, digest: str) -> str:
    """By page and payload, so that rows of one page with other payloads have other ids."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page, url: str | None, payload: bytes, holder) -> bytes:
    """One record: a response with its payload, or a revisit of the holder's response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = holder is not None and holder != page
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if page is not None:
        head.append(f"X-Page-ID: {urllib.parse.quote(str(page))}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(holder, digest)}", f"X-Refers-To-Page: {urllib.parse.quote(str(holder))}"]
    block = HTTP if revisit else HTTP + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame of an open bundle, from its footer."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * width)
    data, out, at = f.read(n * width), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, payload) of the records of a plain frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, n = end + 4, int(fields["Content-Length"])
        block = data[start : start + n]
        yield at, fields, block[block.index(b"\r\n\r\n") + 4 :]
        at = start + n + 4


class _Bundle:
    """An open bundle of one task."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, top = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(top, recursive=True)
        self.path = f"{top}/{uuid.uuid4().hex}.warc.zst"
        self.uri = f"{folder}/{self.path.rsplit('/', 1)[1]}"
        self.out = self.fs.open_output_stream(f"{self.path}.part", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.at, self.plain, self.held, self.size, self.rows = 0, 0, [], 0, []
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, page, data: bytes) -> None:
        self.rows.append((page, self.uri, len(self.frames), self.at, self.size, len(data)))
        self.held.append(data)
        self.plain += len(data)
        self.size += len(data)
        if self.size >= FRAME:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.zstd.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain)))
            self.at += len(packed)
            self.held, self.size = [], 0

    def close(self) -> list[tuple]:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return self.rows


INDEX = ["bundle string", "frame int", "frame_offset long", "offset_in_frame long", "record_bytes long"]


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, folder: str = "") -> DataFrame:
    """Write a record per row and return the index (id, bundle, frame, frame_offset, offset_in_frame, record_bytes)."""
    folder = folder or fresh_path(df.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    narrow = own.select("id", "digest", "bytes")
    holders = narrow.groupBy("digest", "bytes").agg(F.max("id").alias("holder"))
    decided = narrow.distinct().join(holders, ["digest", "bytes"]).where((F.col("bytes") >= revisit_from) & (F.col("id") != F.col("holder")))
    decided = decided.select(F.col("id").alias("i"), F.col("digest").alias("d"), "holder")
    # joined on the id as well, which no payload repeated very often can make uneven
    kind = _id_type(own.schema["id"].dataType)
    rows = own.join(decided, (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("holder").cast("string").alias("holder"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(closed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*closed, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["id", "bundle", "frame", "frame_offset", "offset_in_frame", "record_bytes"])

        bundle = None
        for part in (b for p in parts for b in text_blocks(p, "payload")):
            for page, url, text, holder in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "holder")), strict=True):
                bundle = bundle or _Bundle(folder)
                bundle.add(page, record(page, url, text.encode(), holder))
                if bundle.plain >= BUNDLE:
                    yield rows_of(bundle.close())
                    bundle = None
        if bundle:
            yield rows_of(bundle.close())

    made = rows.mapInArrow(run, "id string, " + ", ".join(INDEX))
    return stored(made.withColumn("id", F.col("id").cast(kind)), "warc-index")


def _id_type(kind: T.DataType) -> T.DataType:
    """The type of ids, if their text tells them."""
    if not isinstance(kind, (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        raise ValueError(f"ids of type {kind.simpleString()} aren't written as text")
    return kind


def _checked(fields: dict[str, str], payload: bytes) -> tuple[int, str, bool]:
    """(length, digest, revisit) of a record: of a response taken from its bytes, which must be what its header states; a revisit has its response's payload and states both."""
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "revisit":
        return n, digest, True
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if (len(payload), own) != (n, digest):
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: payload of {len(payload)} bytes, {own}, where its header states {n}, {digest}")
    return len(payload), own, False


def _frames(part: pa.RecordBatch) -> Iterator[tuple[str, int, list]]:
    """(bundle, frame, records) of each frame that a batch names; records are (offset, fields, payload)."""
    from pyarrow import fs

    zstd = zstandard.ZstdDecompressor()
    for uri, wanted in _by_bundle(part):
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            table = read_seek_table(f)
            for k in wanted:
                at, packed, plain = table[k]
                f.seek(at)
                yield uri, k, parse(zstd.decompress(f.read(packed), max_output_size=plain))


def read_archives(index: DataFrame) -> DataFrame:
    """Read the frames that an index names: (page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, offset_in_frame).

    Lengths and digests of responses are taken from the bytes read; a record that differs from its header is an error.
    """
    frames = index.select("bundle", "frame").distinct()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for uri, k, records in _frames(part):
                rows = []
                for offset, fields, payload in records:
                    n, digest, _ = _checked(fields, payload)
                    rows.append((_name(fields.get("X-Page-ID")), n, digest, fields["WARC-Type"], _name(fields.get("X-Refers-To-Page")), uri, k, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset_in_frame"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    found = frames.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, bundle string, frame int, offset_in_frame long")
    return _in_own_type(found, index)


def fetch(index: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, record_type, refers_to, payload binary) of the wanted ids only: the index leads to their frames, and within these to their records."""
    own = index.join(wanted.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").select("bundle", "frame", "offset_in_frame")
    places = own.groupBy("bundle", "frame").agg(F.collect_list("offset_in_frame").alias("offsets"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            offsets = {(u, k): set(o) for u, k, o in zip(*(part.column(c).to_pylist() for c in ("bundle", "frame", "offsets")), strict=True)}
            for uri, k, records in _frames(part):
                for offset, fields, payload in records:
                    if offset in offsets[uri, k]:
                        _checked(fields, payload)
                        values = [_name(fields.get("X-Page-ID")), fields["WARC-Type"], _name(fields.get("X-Refers-To-Page")), payload]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    names, kinds = ["page_id", "record_type", "refers_to", "payload"], [pa.string(), pa.string(), pa.string(), pa.binary()]
    return _in_own_type(places.mapInArrow(run, "page_id string, record_type string, refers_to string, payload binary"), index)


def _name(text: str | None) -> str | None:
    return None if text is None else urllib.parse.unquote(text)


def _in_own_type(found: DataFrame, index: DataFrame) -> DataFrame:
    """Ids of found in the type that the index has them in."""
    kind = index.schema["id"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def _by_bundle(part: pa.RecordBatch) -> Iterator[tuple[str, list[int]]]:
    """The frames of each bundle of a batch."""
    found: dict[str, list[int]] = {}
    for uri, k in zip(part.column("bundle").to_pylist(), part.column("frame").to_pylist(), strict=True):
        found.setdefault(uri, []).append(k)
    for uri, frames in found.items():
        yield uri, sorted(frames)
