"""Language identification by prediction by partial matching (operator 8).

For each language a context tree of bytes, up to ORDER bytes deep, holds the counts of a bounded training sample.
A byte's probability is that of the longest context seen, with escapes to shorter ones (method C with exclusion), down to
all bytes alike. The counts are frozen; each order of the tree is a sorted array of the contexts and bytes that were seen, with
their code lengths, and one of the contexts with what an escape costs. A text belongs to
the language that codes the whole of it in the fewest bits. ASCII letters are coded in lower case.

A language's tree depends on its own documents only. The sample of a language is its documents in the order of a hash until they have
TRAIN_BYTES, of each at most that many characters and at least one document, so that a language of one huge document is learned
too. Of more than LANGUAGES distinct values those with the most text are learned.

Text that is null or has no letters is `und` with score 0, as is all text if nothing could be learned. Ties go to
the language first in order. A null key is never learned from and not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, sliced, written

ORDER = 3
#: Bytes of text to learn a language from; languages at most. A tree takes about as much memory as two to three times its sample at most.
TRAIN_BYTES, LANGUAGES = 1 << 18, 400
#: Bytes of text that are coded at once.
PART = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b" " * ORDER


def grams(raw: np.ndarray, k: int) -> np.ndarray:
    """The byte at each place from ORDER on and the k before it, the earliest highest."""
    out = raw[ORDER:].astype(np.uint32)
    for j in range(1, k + 1):
        out |= raw[ORDER - j : len(raw) - j].astype(np.uint32) << np.uint32(8 * j)
    return out


@dataclass
class Tree:
    """For each order k: contexts of k bytes with a byte that was seen after them, its bits; and the contexts with the bits of an escape."""

    seen: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes]) -> Tree:
        raw = np.frombuffer(_PAD + _PAD.join(texts), np.uint8)
        tree, below = cls([], [], [], []), None
        for k in range(ORDER + 1):
            keys, counts = np.unique(grams(raw, k), return_counts=True)
            if not len(keys):
                break
            first = np.flatnonzero(np.r_[True, keys[1:] >> 8 != keys[:-1] >> 8])
            kinds = np.diff(np.r_[first, len(keys)])
            total = np.add.reduceat(counts, first)
            # a byte that was seen after a context was seen after each shorter one
            low = below[1][np.searchsorted(below[0], keys & np.uint32(256**k - 1))] if k else np.full(len(keys), 1 / 256)
            left = np.maximum(1 - np.add.reduceat(low, first), 1e-12)
            all_ = np.where(kinds == 256, total, total + kinds)
            p = np.maximum(counts / np.repeat(all_, kinds), 2.0**-60)
            tree.seen.append(keys)
            tree.bits.append(-np.log2(p).astype(np.float32))
            tree.contexts.append(keys[first] >> 8)
            tree.escapes.append(-np.log2(np.maximum(kinds / (total + kinds) / left, 2.0**-60)).astype(np.float32))
            below = keys, p
        return tree

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each, after the ORDER bytes before it."""
        out = np.zeros(len(keys), np.float32)
        left = np.arange(len(keys))
        for k in range(len(self.seen) - 1, -1, -1):
            own = keys[left] if k == ORDER else keys[left] & np.uint32(256 ** (k + 1) - 1)
            at = np.minimum(np.searchsorted(self.seen[k], own), len(self.seen[k]) - 1)
            hit = self.seen[k][at] == own
            out[left[hit]] += self.bits[k][at[hit]]
            left, own = left[~hit], own[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[k], own), len(self.contexts[k]) - 1)
            out[left] += np.where(self.contexts[k][at] == own, self.escapes[k][at], 0)
        out[left] += 8
        return out


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes]] = []  # parts of texts, each with the bytes before it
        size = 0

        def flush() -> None:
            raw = np.frombuffer(b"".join(x for _, x in held), np.uint8)
            ends = np.cumsum([len(x) for _, x in held])
            inner = np.ones(len(raw) - ORDER, bool)
            for e in ends[:-1]:
                inner[e - ORDER : e] = False  # the next part's context isn't coded
            keys, at = np.unique(grams(raw, ORDER)[inner], return_inverse=True)
            begins = np.cumsum([0, *(len(x) - ORDER for _, x in held[:-1])])
            rows = [k for k, _ in held]
            for j, tree in enumerate(self.trees):
                np.add.at(out[:, j], rows, np.add.reduceat(tree.lengths(keys)[at], begins, dtype=np.float64))

        for k, t in enumerate(texts):
            padded = _PAD + t
            for x in range(0, len(t), PART):
                held.append((k, padded[x : x + ORDER + PART]))
                size += len(held[-1][1])
                if size >= PART:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out


def fit(samples: dict[str, list[bytes]]) -> Model:
    """samples: lower-case texts of each language."""
    languages = sorted(samples)
    return Model(languages, [Tree.of(samples[x]) for x in languages])


def held_out(key):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES, languages: int = LANGUAGES) -> Model | None:
    """A model of documents that aren't held out and have a text and a language."""
    rows = docs.where(F.col(f"`{key}`").isNotNull() & ~held_out(f"`{key}`") & (F.octet_length(F.col(f"`{text}`")) > 0) & F.col(f"`{lang}`").isNotNull())
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(1 << 40)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.sum(F.least(F.octet_length("text"), F.lit(train_bytes))).alias("n"), F.min("h").alias("least"), F.sum(F.octet_length("text")).alias("whole"))
    sizes = sizes.orderBy(F.desc("whole"), "lang").limit(languages).collect()
    if not sizes:
        return None
    # twice as much as is needed is expected below the bound, so that it's rarely too little; equal rows are one
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], int(min(1.0, 2 * train_bytes / r["n"]) * (1 << 40))))])
    drawn = rows.where(F.col("h") <= bound[F.col("lang")]).groupBy("lang", "h").agg(F.first(F.left("text", F.lit(train_bytes))).alias("text"))
    samples: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for r in written(drawn, "samples").orderBy("lang", "h").toLocalIterator():
        if held.get(r["lang"], 0) < train_bytes:
            told = r["text"].encode().lower()[: train_bytes - held.get(r["lang"], 0)]
            samples.setdefault(r["lang"], []).append(told)
            held[r["lang"]] = held.get(r["lang"], 0) + len(told)
    return fit(samples)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred and score: the share of the best language's likelihood among all."""
    source = plain_text(docs, key, text=text)
    kind = source.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            told, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if _LETTER.search(t)] if m else []
            if some:
                bits = m.lengths([texts[k].encode().lower() for k in some])
                best = bits.argmin(1)
                share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                for j, k in enumerate(some):
                    told[k], score[k] = m.languages[best[j]], share[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    out = source.mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double")
    return out.select(key, held_out(f"`{key}`").alias("held_out"), "lang_pred", "score")
