"""Media columns: signature sniffing, validation, correction of declared types and carving.

Aho-Corasick finds the magic bytes of all known formats in one pass over the bytes. At each hit a validator of the format
follows its structure and tells the length; only what validates counts. The item at offset 0 gives the true type; validated
items further in are carved as embedded media.

Nulls are empty bytes. Empty or unknown bytes have type application/octet-stream and no items. Repeated rows are stored and
read each, an empty table gives an empty one; very long texts are coded one at a time. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexweave.llm.common import batches, stored, text_blocks

UNKNOWN, UNIT, RATE = "application/octet-stream", 576, 8000

#: Magic bytes, how far into the item they stand, and the family of formats whose validator looks at them.
MAGICS = (
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"BM", 0, "bmp"),
    (b"ftyp", 4, "mp4"),
    (b"OggS", 0, "ogg"),
)
RIFF_FORMS = {b"WAVE": ("audio/wav", {b"fmt ", b"data"}), b"WEBP": ("image/webp", set()), b"AVI ": ("video/x-msvideo", {b"LIST"})}


class Bytes:
    """An item's bytes with searches that go forward only: what was looked for before isn't looked for again, so that hostile bytes cost no more than their length."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {}

    def find(self, what: bytes, at: int) -> int:
        came, place = self.next.get(what, (-1, -2))
        if place == -2 or not came <= at <= (place if place >= 0 else len(self.data)):
            place = self.data.find(what, at)
            self.next[what] = at, place
        return place


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM; an odd number of samples gets the pad byte that RIFF asks for."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + b"\0" * (n % 2)


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file's data chunk."""
    at = 12
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _riff(b: Bytes, at: int) -> tuple[int, str]:
    d = b.data
    kind, wanted = RIFF_FORMS.get(d[at + 8 : at + 12], ("", set()))
    if not kind:
        return 0, ""
    end, p, seen = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, set()
    while p + 8 <= end <= len(d):
        name, n = struct.unpack_from("<4sI", d, p)
        seen.add(name)
        p += 8 + n + n % 2
    return (end - at, kind) if p == end and seen and wanted <= seen else (0, "")


def _png(b: Bytes, at: int) -> tuple[int, str]:
    d, p, first = b.data, at + 8, True
    while p + 12 <= len(d):
        n, name = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or first and name != b"IHDR" or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            break
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p - at, "image/png"
    return 0, ""


def _gif(b: Bytes, at: int) -> tuple[int, str]:
    d = b.data
    if len(d) < at + 13:
        return 0, ""
    p = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    while p < len(d):
        kind = d[p]
        if kind == 0x3B:
            return p + 1 - at, "image/gif"
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 < len(d):
            p += 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0)
        else:
            break
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return 0, ""


_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def _jpeg(b: Bytes, at: int) -> tuple[int, str]:
    """Segments by their lengths; behind the start of each scan its coded bytes up to the next marker."""
    d, p, scans = b.data, at + 2, 0
    while p + 2 <= len(d) and d[p] == 0xFF:
        kind = d[p + 1]
        if kind == 0xD9:
            return (p + 2 - at, "image/jpeg") if scans else (0, "")
        if kind == 0xFF:
            p += 1
            continue
        if p + 4 > len(d) or (n := struct.unpack_from(">H", d, p + 2)[0]) < 2:
            break
        p += 2 + n
        if kind == 0xDA:
            scans += 1
            found = _MARKER.search(d, p)
            if not found:
                break
            p = found.start()
    return 0, ""


_UPDATE = re.compile(rb"[\r\n\t ]*(?:\d+ \d+ obj\b|xref\b)")


def _pdf(b: Bytes, at: int) -> tuple[int, str]:
    """Up to the end mark of the last update: what follows an end mark with an object or a reference table belongs to the file."""
    end, p = 0, at
    while True:
        table = b.find(b"startxref", p)
        stop = b.find(b"%%EOF", max(p, table)) if table >= 0 else -1
        if stop < 0:
            break
        end = p = stop + 5
        if not _UPDATE.match(b.data, p):
            break
    return (end - at, "application/pdf") if end else (0, "")


def _zip(b: Bytes, at: int) -> tuple[int, str]:
    """Local files, then the directory of as many entries, then its end record, each where the one before ends: files inside files don't matter."""
    d, p, files = b.data, at, 0
    while d[p : p + 4] == b"PK\x03\x04" and p + 30 <= len(d):
        flags, method = struct.unpack_from("<HH", d, p + 6)
        packed, name, extra = struct.unpack_from("<I", d, p + 18)[0], *struct.unpack_from("<HH", d, p + 26)
        p, files = p + 30 + name + extra, files + 1
        if flags & 8 and not packed:
            # the size stands behind the data: deflated data tells its own end, stored data doesn't
            if method != 8 or not (packed := _inflated(d, p, -15)):
                return 0, ""
        p += packed
        if flags & 8:
            p += 16 if d[p : p + 4] == b"PK\x07\x08" else 12
    directory, entries = p, 0
    while d[p : p + 4] == b"PK\x01\x02" and p + 46 <= len(d):
        p, entries = p + 46 + sum(struct.unpack_from("<HHH", d, p + 28)), entries + 1
    if d[p : p + 4] != b"PK\x05\x06" or p + 22 > len(d):
        return 0, ""
    listed, size, start, note = struct.unpack_from("<HIIH", d, p + 10)
    good = entries == files == listed and size == p - directory and start == directory - at and p + 22 + note <= len(d)
    return (p + 22 + note - at, "application/zip") if good else (0, "")


def _inflated(d: bytes, at: int, bits: int) -> int:
    """Length of a deflate stream; 0 if it is broken."""
    unpack, p = zlib.decompressobj(bits), at
    try:
        while p < len(d) and not unpack.eof:
            part = unpack.unconsumed_tail or d[p : p + 65536]
            p += 0 if unpack.unconsumed_tail else len(part)
            unpack.decompress(part, 1 << 20)
    except zlib.error:
        return 0
    return p - len(unpack.unused_data) - at if unpack.eof else 0


def _gzip(b: Bytes, at: int) -> tuple[int, str]:
    """A gzip member, by its deflate stream and check value."""
    n = _inflated(b.data, at, 31)
    return (n, "application/gzip") if n else (0, "")


def _bmp(b: Bytes, at: int) -> tuple[int, str]:
    d = b.data
    if len(d) < at + 30:
        return 0, ""
    size, _, data, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or head < 40 or data >= size or at + size > len(d) or width <= 0:
        return 0, ""
    return (size, "image/bmp") if size - data >= (width * depth + 31) // 32 * 4 * abs(height) else (0, "")


_BOX = re.compile(rb"[A-Za-z0-9 ]{4}")


def _mp4(b: Bytes, at: int) -> tuple[int, str]:
    """Boxes one behind the other from ftyp on, among them a movie."""
    d, p, seen = b.data, at, set()
    while at >= 0 and p + 8 <= len(d) and _BOX.match(d, p + 4):
        n, name = struct.unpack_from(">I4s", d, p)
        n = struct.unpack_from(">Q", d, p + 8)[0] if n == 1 and p + 16 <= len(d) else n
        if n < 8 or p + n > len(d) or name == b"ftyp" and seen:
            break
        seen.add(name)
        p += n
    return (p - at, "video/mp4") if {b"ftyp", b"moov"} <= seen else (0, "")


def _ogg(b: Bytes, at: int) -> tuple[int, str]:
    """Pages of one stream up to the one that ends it."""
    d, p = b.data, at
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        flags, segments = d[p + 5], d[p + 26]
        if p == at and not flags & 2:
            break  # not where a stream begins
        p += 27 + segments + sum(d[p + 27 : p + 27 + segments])
        if p > len(d):
            break
        if flags & 4:
            return p - at, "application/ogg"
    return 0, ""


VALIDATORS = {"riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "bmp": _bmp, "mp4": _mp4, "ogg": _ogg}


def automaton():
    """All magic bytes in one Aho-Corasick automaton, bytes as Latin-1 characters."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, inside, family in MAGICS:
        out.add_word(magic.decode("latin-1"), (len(magic) + inside, family))
    out.make_automaton()
    return out


def sniff(data: bytes, found) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each validated item, outermost first; the item at 0 may hold others."""
    own, hits = Bytes(data), []
    for end, (n, family) in found.iter(data.decode("latin-1")):
        hits.append((end + 1 - n, family))
    items, free = [], 0
    for at, family in sorted(hits):
        if at >= free:
            size, kind = VALIDATORS[family](own, at)
            if size:
                items.append((at, size, kind))
                free = at + size if at else free  # what the whole itself holds is carved too
    return items


def judged(data: bytes, declared: str | None, found) -> tuple[str, bool, int, list[tuple[int, int, str]]]:
    """(type, corrected, length, embedded items): the declared type stays where nothing validates at the start."""
    items = sniff(data, found)
    own = next((x for x in items if x[0] == 0), (0, 0, UNKNOWN))
    return own[2], own[2] != UNKNOWN and own[2] != declared, own[1], [x for x in items if x[0] > 0]


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(id, n_bytes, declared, media binary): each text's UTF-8 bytes, filled with 255 to a positive multiple of unit, as samples of a WAV file."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in text_blocks(p, text_col)):
            raw = [t.encode() for t in batches(part.column(text_col))]
            media = [wav(b.ljust(max(1, -(-len(b) // unit)) * unit, b"\xff")) for b in raw]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([len(b) for b in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array(media, pa.binary())], names=["id", "n_bytes", "declared", "media"])

    own = df.select(id_col, text_col)
    return own.mapInArrow(run, f"id {own.schema[id_col].dataType.simpleString()}, n_bytes long, declared string, media binary")


def inspect(df: DataFrame, id_col: str = "id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """(id, declared, type, corrected, length, embedded array<struct<offset,length,type,content>>) of a media column."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for part in (b for p in parts for b in text_blocks(p, media_col)):
            rows = []
            for declared, data in zip(part.column(declared_col).to_pylist(), part.column(media_col).to_pylist(), strict=True):
                data = data or b""
                kind, corrected, length, inner = judged(data, declared, found)
                rows.append((declared, kind, corrected, length, [{"offset": a, "length": n, "type": k, "content": data[a : a + n]} for a, n, k in inner]))
            columns = list(zip(*rows, strict=True))
            types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "declared", "type", "corrected", "length", "embedded"])

    own = df.select(id_col, declared_col, media_col)
    return own.mapInArrow(run, f"id {own.schema[id_col].dataType.simpleString()}, declared string, type string, corrected boolean, length long, embedded array<struct<offset:long,length:long,type:string,content:binary>>")


def read_media(df: DataFrame) -> DataFrame:
    """Read stored WAV media back: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    feature: type by its bytes, whether that corrects the declared one, length, embedded items with their types, mean and deviation of the samples in thousandths, and sign changes about the mean.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for part in (b for p in parts for b in text_blocks(p, "media")):
            rows = []
            for data, declared in zip(part.column("media").to_pylist(), part.column("declared").to_pylist(), strict=True):
                media_type, corrected, length, inner = judged(data, declared, found)
                if (media_type, length) != ("audio/wav", len(data)):
                    raise ValueError("stored media doesn't validate")
                samples = wav_samples(data)
                x = np.frombuffer(samples, np.uint8)
                total, squares, n = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum()), len(x)
                above = x.astype(np.int64) * n >= total
                feature = f"{media_type};{'corrected' if corrected else 'declared'};{length};{len(inner)}{''.join(',' + k for k in sorted({k for _, _, k in inner}))};{1000 * total // n};{round(1000 * max(0, squares / n - (total / n) ** 2) ** 0.5)};{int((above[1:] != above[:-1]).sum())}"
                rows.append((n, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *columns], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    own = df.select("id", "n_bytes", "declared", "media")
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts as a media table in the shared folder, and read it back."""
    return read_media(stored(with_media(df, id_col, text_col), "media"))
