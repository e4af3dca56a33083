"""Byte-level BPE encoding and decoding by a local rank file (operator 3).

Empty or null text: no ids, no bytes. Equal rows give equal rows; a null doc_id is kept. Very long
texts are cut where no match of the pattern can span the cut, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import plain_text, sliced

#: Characters of a piece that the library gets at once.
PIECE_CHARS = 1 << 16
#: After an ASCII letter, digit or mark that isn't white space, a blank or line feed starts a new match.
SAFE_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")
#: Texts without blanks: a match that has ASCII letters ends before an ASCII mark or digit.
LAST_CUT = re.compile(r"(?<=[A-Za-z])(?=[!-@\[-`{-~])")


def cuts(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of about `size` characters whose ids, joined, are those of the text."""
    if len(text) <= size:
        return [text]
    pieces, start = [], 0
    while len(text) - start > size:
        m = SAFE_CUT.search(text, start + size, start + 4 * size) or LAST_CUT.search(text, start + size) or SAFE_CUT.search(text, start + size)
        if not m:
            break
        pieces.append(text[start : m.start()])
        start = m.start()
    pieces.append(text[start:])
    return pieces


class ByteBPE:
    """The tiktoken library over a rank file, without special tokens."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = [np.asarray(self.library.encode_ordinary(p), dtype="<u4") for p in cuts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """Raw bytes; ids that end inside a character decode as well."""
        return b"".join(self.library.decode_bytes(ids[k : k + (1 << 20)].tolist()) for k in range(0, len(ids), 1 << 20))


@functools.cache
def coder(ranks: str, pattern: str) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(ranks, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, the bytes decoded from ids."""
    source = plain_text(docs, key, text=text)
    kind = source.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in sliced(batches, 1):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            out = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            names = [key, "n_tokens", "ids"]
            if decoded:
                out.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(encode, f"`{key}` {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the raw bytes of a binary column of ids; null ids decode to no bytes."""
    source = encoded.select(f"`{key}`", f"`{ids}`")
    kind = source.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()], pa.binary())], [key, "decoded"])

    return source.mapInArrow(decode, f"`{key}` {kind}, decoded binary")
