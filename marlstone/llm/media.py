"""Media columns by signature sniffing (operator 6).

An Aho-Corasick automaton finds every magic number of a blob at once. A validator for the format then walks
its structure and gives its length, or rejects the place. A blob's type is that of the medium at its start,
whatever was declared; media that start later are carved from it, the first of those that overlap.
Null or empty blobs have no type and no media. Text that merely contains a magic number stays text.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, sliced, written

#: Bytes of payload are a multiple of this, filled up with 255.
FRAME = 576
RATE = 8000

# Magic numbers, how far from the start of the file they stand, and the type they tell.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"WEBPVP8", 8, "image/webp"),
    (b"AVI LIST", 8, "video/avi"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (name == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p - at
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:
            p += 1 if kind == 0xFF else 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind < 0xC0:
            return 0
        p += 2 + n
        if kind == 0xDA:  # coded data run to the next marker that is neither stuffed nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) - at else 0


def _riff(b: bytes, at: int) -> int:
    if b[at : at + 4] != b"RIFF":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p = at + 12
    while p + 8 <= end:
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + n % 2
    return end - at if p in (end, end + 1) else 0


def _flac(b: bytes, at: int) -> int:
    """The metadata blocks; the frames after them reach the blob's end."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 0x7F or n != 34) or p + 4 + n > len(b):
            return 0
        p, first = p + 4 + n, False
        if kind & 0x80:
            return len(b) - at if b[p : p + 1] == b"\xff" else 0
    return 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return 0
        p += size
    return p - at


def _mp4(b: bytes, at: int) -> int:
    p, names = at, set()
    while p + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not name.isalnum():
            break
        names.add(name)
        p += n
    return p - at if names & {b"moov", b"mdat"} else 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _zip(b: bytes, at: int) -> int:
    """The first end record whose directory starts with an entry and ends at the record."""
    p = at
    while (p := b.find(b"PK\x05\x06", p)) >= 0 and p + 22 <= len(b):
        size, start = struct.unpack_from("<II", b, p + 12)
        end = p + 22 + struct.unpack_from("<H", b, p + 20)[0]
        if at + start + size == p and b[at + start : at + start + 4] == b"PK\x01\x02" and end <= len(b):
            return end - at
        p += 4
    return 0


def _gzip(b: bytes, at: int) -> int:
    flow = zlib.decompressobj(31)
    rest = memoryview(b)[at:]
    try:
        while rest and not flow.eof:
            flow.decompress(rest, 1 << 20)
            rest = flow.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(flow.unused_data) if flow.eof else 0


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff, "video/avi": _riff,
    "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, offset, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) - 1 + offset, kind))
    found.make_automaton()
    return found


def media_in(blob: bytes | None) -> list[tuple[str, int, int]]:
    """Type, start and length of each medium; none overlaps an earlier one."""
    out, past = [], 0
    if not blob:
        return out
    for end, (back, kind) in sorted(automaton().iter(blob.decode("latin-1")), key=lambda x: x[0] - x[1][0]):
        at = end - back
        if at >= past and (n := VALIDATORS[kind](blob, at)):
            out.append((kind, at, n))
            past = at + n
    return out


SNIFFED = "media_type string, corrected boolean, parts array<struct<media_type:string,start:bigint,length:bigint>>"


def sniff(df: DataFrame, key: str = "doc_id", blob: str = "media", declared: str | None = None) -> DataFrame:
    """key, blob, its true type (null: none that is known), whether that differs from the declared one, and all media in it."""
    source = df.select(F.col(f"`{key}`"), F.col(f"`{blob}`").alias("media"), (F.col(f"`{declared}`") if declared else F.lit(None)).cast("string").alias("declared"))
    kind = source.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [media_in(b) for b in batch.column(1).to_pylist()]
            types = [x[0][0] if x and x[0][1] == 0 else None for x in found]
            wrong = [t is not None and d is not None and t != d for t, d in zip(types, batch.column(2).to_pylist())]
            parts = pa.array([[{"media_type": t, "start": a, "length": n} for t, a, n in x] for x in found], pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array(wrong), parts], [key, "media", "media_type", "corrected", "parts"])

    return source.mapInArrow(look, f"`{key}` {kind}, media binary, {SNIFFED}")


def carve(sniffed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each medium: key, its number, type, start, length and bytes."""
    rows = sniffed.select(f"`{key}`", "media", F.posexplode("parts").alias("part", "is"))
    return rows.select(f"`{key}`", "part", "is.*", F.expr("substring(media, int(is.start) + 1, int(is.length))").alias("bytes"))


def as_samples(payload: bytes) -> bytes:
    """A WAV file with the payload as 8-bit samples, one channel."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples_of(blob: bytes) -> bytes:
    """The samples of a WAV file, from its data chunk."""
    p = 12
    while (head := struct.unpack_from("<4sI", blob, p))[0] != b"data":
        p += 8 + head[1] + head[1] % 2
    return blob[p + 8 : p + 8 + head[1]]


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media and declared_type: each text as a WAV file, in a table of the shared folder."""
    source = plain_text(docs, key, text=text)
    kind = source.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            blobs = [as_samples(t + b"\xff" * (max(1, -(-len(t) // FRAME)) * FRAME - len(t))) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(blobs, pa.binary()), pa.array(["application/octet-stream"] * len(raw))], [key, "n_bytes", "media", "declared_type"])

    return written(source.mapInArrow(pack, f"`{key}` {kind}, n_bytes bigint, media binary, declared_type string"), "media")


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and sniffed features of stored media, read from their bytes.

    feature: true type, samples, embedded media, and the mean and range of the samples.
    """
    kind = stored.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in sliced(batches, 2):
            rows = []
            for n, blob, declared in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                found = media_in(blob)
                assert found and found[0] == ("audio/wav", 0, len(blob)), "not a whole WAV file"
                payload = samples_of(blob)
                x = np.frombuffer(payload, np.uint8)
                inner = media_in(payload)
                told = f"{found[0][0]};corrected={int(found[0][0] != declared)};samples={len(x)};embedded={','.join(f'{t}@{a}+{m}' for t, a, m in inner)};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};range={x.min()}-{x.max()}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), told))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols)], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(key, "n_bytes", "media", "declared_type").mapInArrow(look, f"`{key}` {kind}, {FEATURES}")
