"""Benchmark decontamination by an FM-index for each training shard (operator 9).

A shard is a slice of whole documents. Its words become ids of the benchmark's vocabulary; a word that no
benchmark item has ends a run, and runs shorter than the shortest window can hold none, so they are left out.
Over the runs there is an FM-index: suffix order, Burrows-Wheeler transform, wavelet tree and sampled suffix
positions. All windows are searched backwards at once through wavelet-tree ranks; the rows found are located
by walking to a sampled position, and overlapping places are merged to spans.

Null text has no words and null items no windows; an item_id of null counts as the empty string, and equal
item_ids are one item. Every row of the documents keeps its row; empty tables give no rows or no hits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

WINDOW = 8
SAMPLE = 8
SHARD_BYTES = 16 << 20
#: Bytes of benchmark text that a worker holds at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 32 << 20
#: Words: all but ASCII characters that are neither digits nor letters; A-Z in lower case.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of s by prefix doubling; each 0 is a symbol of its own, less than all others, in text order."""
    n = len(s)
    zeros = s == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, s + int(zeros.sum()))
    sizes = np.bincount(rank)
    rank = (np.cumsum(sizes) - sizes)[rank]  # a suffix's rank: how many are less, of those told apart so far
    step = 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        order = np.lexsort((after, rank[tied]))
        own, after, place = rank[tied][order], after[order], np.arange(len(tied))
        new = np.r_[True, own[1:] != own[:-1]]
        apart = new | np.r_[True, after[1:] != after[:-1]]
        within = place - np.maximum.accumulate(np.where(new, place, 0))
        rank[tied[order]] = own + within[np.maximum.accumulate(np.where(apart, place, 0))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Ranks of symbols, a level of bits for each binary digit from the highest."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.digits = max(1, int(top).bit_length())
        self.ones, self.zeros, s = [], [], symbols
        for k in range(self.digits - 1, -1, -1):
            bit = s >> k & 1 == 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are `symbol`."""
        low, at = np.zeros_like(at), at
        for k, ones, zeros in zip(range(self.digits - 1, -1, -1), self.ones, self.zeros):
            bit = symbol >> k & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - low


class FMIndex:
    def __init__(self, s: np.ndarray, top: int):
        """s: symbols 0..top, of which 0 parts runs."""
        order = suffix_order(s)
        self.bwt = np.where(order > 0, s[order - 1], 0)
        self.tree = WaveletTree(self.bwt, top)
        self.less = np.r_[0, np.cumsum(np.bincount(s, minlength=top + 1))]
        before = np.where(order > 0, s[order - 1], 0)
        run = np.arange(len(s)) - np.maximum.accumulate(np.where(s == 0, np.arange(len(s)) + 1, 0))
        kept = (before == 0) | (run[order] % SAMPLE == 0)  # run starts too: no walk leaves its run
        self.kept = np.r_[0, np.cumsum(kept)]
        self.sample = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each phrase (a matrix, filled up on the right), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt))
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > k) & (low < high))
            c = phrases[on, k]
            low[on], high[on] = (self.less[c] + self.tree.rank(c, x[on]) for x in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking to sampled suffixes."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = at[left]
            done = self.kept[r + 1] > self.kept[r]
            out[left[done]] = self.sample[self.kept[r[done]]] + steps[left[done]]
            left, r = left[~done], r[~done]
            c = self.bwt[r]
            at[left] = self.less[c] + self.tree.rank(c, r)
            steps[left] += 1
        return out


class Phrases:
    """The windows of benchmark items over their vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        told: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                told.setdefault(tuple(w[k : k + window]), set()).add(item)
        self.items = [sorted(x) for x in told.values()]
        self.lengths = np.array([len(p) for p in told], np.int64)
        self.least = int(self.lengths.min(initial=window))
        self.matrix = np.zeros((len(told), window), np.int64)
        for k, p in enumerate(told):
            self.matrix[k, : len(p)] = p

    def found(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Words, merged spans of hit words and items with a window inside, of each text of a shard."""
        counts, kept, owner, first, size = [], [], [], [], 0
        get, none = self.ids.get, itertools.repeat(0)
        for k, text in enumerate(texts):
            w = words_of(text)
            counts.append(len(w))
            if len(w) < self.least:
                continue
            s = np.fromiter(map(get, w, none), np.int32, len(w))
            edge = np.flatnonzero(np.diff(np.r_[0, s > 0, 0].astype(np.int8)))
            begins, ends = edge[::2], edge[1::2]
            for b, e in zip(begins[(fits := ends - begins >= self.least)].tolist(), ends[fits].tolist()):
                kept += [s[b:e], _ZERO]
                owner.append(k)
                first.append((size, b))
                size += e - b + 1
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(n, [], set()) for n in counts]
        if not kept or not len(self.lengths):
            return out
        index = FMIndex(np.concatenate(kept).astype(np.int64), len(self.ids))
        low, high = index.search(self.matrix, self.lengths)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[phrase]
        at = index.locate(rows)
        begins = np.array(first)
        run = np.searchsorted(begins[:, 0], at, "right") - 1
        start = at - begins[run, 0] + begins[run, 1]
        doc = np.array(owner)[run]
        order = np.lexsort((start, doc))
        last = -1
        for d, b, p in zip(doc[order].tolist(), start[order].tolist(), phrase[order].tolist()):
            e = b + int(self.lengths[p])
            spans = out[d][1]
            if d == last and b <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((b, e))
            out[d][2].update(self.items[p])
            last = d
        return out


_ZERO = np.zeros(1, np.int32)


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what is between them."""
    raw = text.encode()
    ends, at = [], 0
    for w in (folded := raw.translate(_FOLD)).split():
        at = folded.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for b, e in spans:
        out.append(raw[at : ends[b][0]])
        at = ends[e - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size; item ids as strings."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    for k in range(n):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, remove: int = 0, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns (all if None) and what was found in the text.

    found: n_words, spans (of words: start, end) and items. With remove = n there is no such column:
    documents with n items or more go, and the others lose their spans.
    """
    keep = docs.columns if keep is None else keep
    found = "found"
    while found.lower() in {c.lower() for c in docs.columns}:
        found += "_"
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
    spark_kind = T.StructType.fromDDL("n_words bigint, spans array<struct<start:int,end:int>>, items array<string>")
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    out, block, k = docs.select([F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]), next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        last = after is None
        names = list(keep if last else out.columns[: len(dict.fromkeys([*keep, text]))])
        fields = [out.schema[c] for c in names]
        if not (last and remove):
            fields = [*fields, T.StructField(found, spark_kind)]

        def search(batches: Iterator[pa.RecordBatch], block=block, k=k, last=last, names=names) -> Iterator[pa.RecordBatch]:
            phrases, at = Phrases(block), None
            for batch in sliced(batches, at_text, SHARD_BYTES):
                at = batch.schema.names
                texts = batch.column(at_text).to_pylist()
                got = phrases.found([t or "" for t in texts])
                if k:
                    old = batch.column(at.index(found)).to_pylist()
                    got = [(n, merged(s, [(x["start"], x["end"]) for x in o["spans"]]), i | set(o["items"])) for (n, s, i), o in zip(got, old)]
                cols = [batch.column(at.index(c)) for c in names]
                if last and remove:
                    stay = np.array([len(i) < remove for _, _, i in got])
                    if text in names:
                        lost = [t if not s or not ok else without(t, s) for t, (_, s, _), ok in zip(texts, got, stay)]
                        cols[names.index(text)] = pa.array(lost, pa.string())
                    yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(stay))
                else:
                    told = pa.array([{"n_words": n, "spans": [{"start": b, "end": e} for b, e in s], "items": sorted(i)} for n, s, i in got], kind)
                    yield pa.RecordBatch.from_arrays([*cols, told], [*names, found])

        at_text = out.columns.index(text)
        out = out.mapInArrow(search, T.StructType(fields))
        block, k = after, k + 1
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_items: int = 2, **more) -> DataFrame:
    """The documents without those that hold `most_items` items or more; the rest lose the spans of theirs."""
    return scan(docs, benchmark, remove=most_items, **more)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: What is found, over DuckDB's `documents` and `benchmark`, by joining windows.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
phrase AS (SELECT DISTINCT item, list_slice(w, k, k + {WINDOW - 1}) AS p FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS k FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(p) AS n FROM phrase),
spot AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, k, item FROM spot JOIN phrase USING (p)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT doc_id, n, k FROM hit)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
