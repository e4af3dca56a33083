"""Token ids in bit-plane files with a chunk index (operator 4).

A chunk holds the ids of whole documents, in ascending document order, as fixed-size blocks. Each block is
transposed to planes of bytes or bits, and each plane is compressed with zstandard by itself. A chunk is a
row of a Parquet table in the shared folder, so that a lost writer leaves nothing behind; the chunk index
is a second table: place, first document, documents, ids and the ids before it.

Null text is the empty text: its ids are the end id alone. Documents with equal or null keys (null first)
are in the order of their texts. An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, scratch_path, sliced
from .word_tokens import word_encoder

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19
LEVEL = 1
CHUNK = "shard int, chunk int, before bigint, n_ids bigint, keys array<{kind}>, lengths array<int>, planes array<array<binary>>"


def pack(ids: np.ndarray, bits: bool = False, level: int = LEVEL, width: int | None = None) -> list[list[bytes]]:
    """Blocks of compressed planes of unsigned 32-bit ids.

    Byte planes that are zero throughout the ids are left out; every block has as many planes.
    """
    press = zstandard.ZstdCompressor(level=level)
    width = width or max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    out = []
    for at in range(0, len(ids), BLOCK_IDS):
        planes = np.ascontiguousarray(ids[at : at + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
        if bits:
            planes = np.packbits(np.unpackbits(planes[:, :, None], axis=2).transpose(0, 2, 1).reshape(8 * width, -1), axis=1)
        out.append([press.compress(p.tobytes()) for p in planes])
    return out


def unpack(blocks: list[list[bytes]], n_ids: int, bits: bool = False) -> np.ndarray:
    """The ids of pack()."""
    open_ = zstandard.ZstdDecompressor()
    out = np.zeros((n_ids, 4), np.uint8)
    for k, planes in enumerate(blocks):
        at, to = k * BLOCK_IDS, min(n_ids, (k + 1) * BLOCK_IDS)
        raw = np.stack([np.frombuffer(open_.decompress(p), np.uint8) for p in planes])
        if bits:
            raw = np.packbits(np.unpackbits(raw, axis=1, count=to - at).reshape(len(planes) // 8, 8, to - at).transpose(0, 2, 1), axis=2)[:, :, 0]
        out[at:to, : len(raw)] = raw.T
    return out.reshape(-1).view("<u4")


@dataclass
class PlaneStore:
    """Where the chunks and their index are, and how planes are cut."""

    chunks: str
    index: str
    bits: bool
    key: str
    kind: str


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, bits: bool = False, key: str = "doc_id", text: str = "text", path: str | None = None) -> PlaneStore:
    """Encode, append end_id to each document, and write chunks and their index in ascending order of key."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "planes")
    source = plain_text(docs, key, text=text)
    kind = source.schema[key].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer)
        shard, chunk, before, keys, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def full() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[shard], [chunk], [before], [len(ids)], [keys], [[len(x) // 4 for x in held]], [pack(ids, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], schema_names)

        for batch in sliced(batches, 1, 1 << 20):
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int32()), pa.list_(pa.list_(pa.binary()))]
            for k, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                keys.append(k)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= CHUNK_IDS:
                    yield full()
                    chunk, before, keys, held, size = chunk + 1, before + size, [], [], 0
        if held:
            yield full()

    schema_names = ["shard", "chunk", "before", "n_ids", "keys", "lengths", "planes"]
    ranged = source.repartitionByRange(_shards(spark), F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), "text")
    ranged.mapInArrow(chunks, CHUNK.format(kind=kind)).write.parquet(f"{path}/chunks")
    rows = spark.read.schema(CHUNK.format(kind=kind)).parquet(f"{path}/chunks")
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each writer
    starts, at = [], 0
    for r in totals:
        starts.append((r["shard"], at))
        at += r["n"]
    bases = spark.createDataFrame(starts, "shard int, base bigint")
    index = rows.select("shard", "chunk", "n_ids", F.col("keys")[0].alias("first_key"), F.size("keys").alias("n_docs"), "before")
    index = index.join(F.broadcast(bases), "shard").select("shard", "chunk", "first_key", "n_docs", "n_ids", (F.col("base") + F.col("before")).alias("start"))
    index.write.parquet(f"{path}/index")
    return PlaneStore(f"{path}/chunks", f"{path}/index", bits, key, kind)


def _shards(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_store(spark, store: PlaneStore, with_ids: bool = True) -> DataFrame:
    """key, start, n_tokens, the ids' crc32 and ids (little-endian unsigned 32-bit integers), one row for each document, from the files."""
    kind, bits = store.kind, store.bits
    rows = spark.read.schema(CHUNK.format(kind=kind)).parquet(store.chunks).select("shard", "chunk", "n_ids", "keys", "lengths", "planes")
    index = spark.read.parquet(store.index).select("shard", "chunk", "start")

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, keys, lengths, planes, start = (batch.column(c)[r].as_py() if c != 3 else batch.column(c).slice(r, 1).flatten() for c in (2, 3, 4, 5, 6))
                ids, ends = unpack(planes, n, bits), np.cumsum(lengths, dtype=np.int64)
                begins = ends - np.asarray(lengths)
                parts = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
                cols = [keys, pa.array(start + begins, pa.int64()), pa.array(np.asarray(lengths, np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [store.key, "start", "n_tokens", "crc32", "ids"][: len(cols)])

    # The index has a few numbers for each half million ids; Spark broadcasts it while it is small, and else shuffles.
    joined = rows.join(index, ["shard", "chunk"]).select("shard", "chunk", "n_ids", "keys", "lengths", "planes", "start")
    return joined.mapInArrow(open_, f"`{store.key}` {kind}, start bigint, n_tokens bigint, crc32 bigint" + ", ids binary" * with_ids)
