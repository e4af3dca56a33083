"""Signature sniffing, carving and the sample store."""

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from marlstone.llm import media


def png(w=3, h=2):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + b"\0" * 9 + b"\xff\xda\x00\x04ab" + b"data\xff\x00more\xff\xd0" + b"\xff\xd9"
BMP = struct.pack("<2sIIII", b"BM", 58, 0, 54, 40) + b"\0" * 40
WAV = media.as_samples(b"abcd")
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
GZ = gzip.compress(b"x" * 100)
box = lambda n, d: struct.pack(">I4s", 8 + len(d), n) + d
MP4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"1234")
OGG = b"OggS\0" + b"\0" * 21 + bytes([1, 3]) + b"abc"
z = io.BytesIO()
with zipfile.ZipFile(z, "w") as f:
    f.writestr("a", "b")
ZIP = z.getvalue()
ALL = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": WAV, "application/pdf": PDF, "application/gzip": GZ, "video/mp4": MP4, "audio/ogg": OGG, "application/zip": ZIP}


def test_each_format_alone_embedded_and_cut_short():
    for kind, blob in ALL.items():
        assert media.media_in(blob) == [(kind, 0, len(blob))], kind
        assert media.media_in(b"junk" + blob + b"tail") == [(kind, 4, len(blob))], kind
        assert kind not in [k for k, a, _ in media.media_in(blob[:-1]) if a == 0], kind
    assert media.media_in(None) == media.media_in(b"") == media.media_in(b"GIF89a is a magic number, BM too") == []


def test_sniff_corrects_and_carves(spark):
    both = b"--" + png() + b"==" + GIF + b"++"
    rows = [(1, bytearray(png()), "image/gif"), (2, bytearray(both), None), (3, None, "image/png"), (4, bytearray(GIF), "image/gif"), (None, bytearray(b"text"), "text/plain")]
    seen = media.sniff(spark.createDataFrame(rows, "doc_id bigint, media binary, told string"), declared="told")
    got = {r.doc_id: (r.media_type, r.corrected, len(r.parts)) for r in seen.collect()}
    assert got == {1: ("image/png", True, 1), 2: (None, False, 2), 3: (None, False, 0), 4: ("image/gif", False, 1), None: (None, False, 0)}
    assert sorted((r.doc_id, r.part, bytes(r.bytes)) for r in media.carve(seen).collect()) == [(1, 0, png()), (2, 0, png()), (2, 1, GIF), (4, 0, GIF)]


def test_texts_come_back_whole(spark):
    texts = ["", None, "é", "x" * 576, "y" * 577, "RIFF WAVEfmt GIF89a %PDF-", "z" * 5_000_000, "é"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "é", "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, media string")
    got = {r.doc_id: r for r in media.features(media.store_texts(docs)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        blob = media.as_samples(payload)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
    assert got[2].feature == got[7].feature == got[None].feature
    assert media.features(media.store_texts(docs.limit(0))).count() == 0
