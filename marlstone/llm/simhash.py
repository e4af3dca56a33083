"""SimHash near-duplicates by a Gray-order hierarchical index (operator 1).

Fingerprints of shingles link when few bits differ. The index is a tree of masked bit patterns. Its top nodes
are (mask, pattern) pairs: of r + k blocks of bits, any two fingerprints within r bits share k whole blocks,
so both hang below a common top node; top nodes that hold too many are split by further masks. Below, the
fingerprints are sorted by Gray rank; runs of neighbours share a node that keeps the bits they agree on. Two
nodes are compared by those bits first, and pairs of groups with too many differences go at once. Only edges
that join two trees leave a task, so a group of n near copies gives less than n edges, not all pairs.

Null text and text without words have fingerprint zero and link like any other. Repeated rows, ties and null
ids keep their rows; a component whose ids are all null has a null id. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, sliced, written
from .components import components, forest

SEED, BITS = 42, 64
#: near_copies: bits that first candidates may differ in, bins in a sketch of shingles.
NEAR_BITS, SKETCH = 3, 256
#: Shingles counted at once; children of a node; rows of a top node beyond which it is split; node pairs at once.
STEP, FAN, HOT, PAIRS = 1 << 16, 16, 20_000, 8192
#: How often a top node is split. It leaves 19 bits open then at radius 2 (22 at 3), so it can't hold more than 2 to that power distinct ones.
DEPTH = 2
#: One of so many fingerprints is counted to tell which top nodes are large.
HOT_SHARE = 16
#: Texts in which shingles are counted to tell the common ones, and how many of them make a shingle common.
TOLD, COMMON = 8192, 3
#: How much further apart in a group of a prefix key each round looks.
WIDER = 16
#: Rows of the index that a worker holds, unless one top node has more.
HELD = 200_000


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space."""
    return text.encode().lower().split()


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of `size` words, repeats included; fewer words make one."""
    if len(words) < size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(size))))


def fingerprint(text: str, size: int = 3, seed: int = SEED) -> int:
    """Bits that over half of the shingles' hashes have."""
    told, seen, count = shingles(words_of(text), size), np.zeros(BITS, np.int64), 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    while True:
        h = np.fromiter(map(digest, itertools.islice(told, STEP)), "<u8")
        if not len(h):
            break
        count += len(h)
        seen += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * seen > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key and fp, the fingerprint's 64 bits as bigint."""
    source = plain_text(docs, key, text=text)
    kind = source.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            fp = np.fromiter((fingerprint(t, size, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return source.mapInArrow(make, f"`{key}` {kind}, fp bigint")


def blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n nearly equal blocks of bit positions."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def top_masks(radius: int, shared: int) -> list[int]:
    """Masks of `shared` blocks out of radius + shared."""
    return [sum(m) for m in itertools.combinations(blocks(list(range(BITS)), radius + shared), shared)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask and one of radius + 1 blocks of the bits that it lacks."""
    return [mask | m for m in blocks([b for b in range(BITS) if not mask >> b & 1], radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp):
    """Where the bits stand in the sequence of Gray codes, as a Column."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


class GrayIndex:
    """A forest over groups of Gray-sorted fingerprints; each level keeps the pattern and the mask that a run shares."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """group: number of the top node of each row, ascending."""
        full = np.full(len(fps), np.uint64(2**64 - 1))
        self.levels = [(fps, full, None)]
        pattern, mask = fps, full
        while True:
            new = np.r_[True, group[1:] != group[:-1]]
            place = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            if len(self.levels) > 1 and not place.any():
                break
            begin = np.flatnonzero(new | (place % FAN == 0))
            first = np.repeat(pattern[begin], np.diff(np.r_[begin, len(group)]))
            mask = np.bitwise_and.reduceat(mask & ~(pattern ^ first), begin)
            pattern, group = pattern[begin], group[begin]
            self.levels.append((pattern, mask, np.r_[begin, len(place)]))

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows x < y of one group that differ in at most `radius` bits, and in how many; see `joined`."""
        roots = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, roots, roots)]
        fan = np.arange(FAN)
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS:
                stack += [(level, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
                continue
            if level == 1:
                keep = self.apart(a, b)
                a, b = a[keep], b[keep]
            pattern, mask, _ = self.levels[level - 1]
            begin = self.levels[level][2]
            x, y = begin[a][:, None] + fan, begin[b][:, None] + fan
            ok = (x < begin[a + 1][:, None])[:, :, None] & (y < begin[b + 1][:, None])[:, None, :]
            ok &= (a != b)[:, None, None] | ((fan[:, None] < fan) if level == 1 else (fan[:, None] <= fan))
            at, i, j = np.nonzero(ok)
            x, y = x[at, i], y[at, j]
            differ = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y])
            near = differ <= radius
            x, y = x[near], y[near]
            if level == 1:
                if len(x):
                    yield x, y, differ[near]
            elif len(x):
                stack.append((level - 1, x, y))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of lowest nodes that aren't yet in one component throughout."""
        begin = self.levels[1][2][:-1]
        low, high = np.minimum.reduceat(self.label, begin), np.maximum.reduceat(self.label, begin)
        return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])

    def joined(self, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A spanning forest of the links, with nearer pairs first among those met at once."""
        self.label = np.arange(len(self.levels[0][0]))
        out = []
        for x, y, d in self.links(radius):
            order = np.argsort(d, kind="stable")
            x, y, d = x[order], y[order], d[order]
            self.label, used = forest(x, y, len(self.label), self.label)
            out.append((x[used], y[used], d[used]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def links(nodes: DataFrame, radius: int, shared: int = 1, hot: int = HOT) -> DataFrame:
    """a, b, differ: edges that connect what differs in at most `radius` bits. nodes: node (bigint) and fp, both distinct, in the shared folder."""
    spark = nodes.sparkSession
    masks = top_masks(radius, shared)
    rows = nodes.select("node", "fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    parts = []
    for level in range(DEPTH + 1):
        rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        if level == DEPTH:
            parts.append(rows)
            break
        # which top nodes are split decides the work only, never what is found: a share of the rows tells them well enough
        told = rows.where(F.pmod(F.xxhash64("node"), F.lit(HOT_SHARE)) == 0).groupBy("mask", "pattern").count()
        large = written(told.where(F.col("count") * HOT_SHARE > hot).select("mask", "pattern"), "hot")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, ["mask", "pattern"], "left_anti").select("node", "fp", "mask", "pattern"))
        finer = {m: finer_masks(m, radius) for m in masks}
        table = F.create_map(*[x for m, f in finer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(s)) for s in f]))])
        rows = rows.join(large, ["mask", "pattern"], "left_semi").select("node", "fp", F.explode(table[F.col("mask")]).alias("mask"))
        masks = [s for f in finer.values() for s in f]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def found(node, fp, mask, pattern):
            group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            several = np.bincount(group)[group] > 1
            if several.any():
                node = node[several]
                x, y, d = GrayIndex(fp[several].view(np.uint64), group[several]).joined(radius)
                for k in range(0, len(x), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(node[x[k : k + 100_000]]), pa.array(node[y[k : k + 100_000]]), pa.array(d[k : k + 100_000].astype(np.int32))], ["a", "b", "differ"])

        def whole():
            return [np.concatenate(c) for c in zip(*held)]

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in range(4)])
            size += batch.num_rows
            if size >= HELD:
                cols = whole()
                ends = np.flatnonzero((cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1]))
                if len(ends):
                    yield from found(*(c[: ends[-1] + 1] for c in cols))
                    cols = [c[ends[-1] + 1 :] for c in cols]
                held, size = [cols], len(cols[0])
        if held:
            yield from found(*whole())

    return rows.select("node", "fp", "mask", "pattern").mapInArrow(search, "a bigint, b bigint, differ int")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component_id (the smallest key that links lead to): one row for each document."""
    own = written(fingerprints(docs, size, key, text), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = written(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(key, "fp", "component_id")


def shingle_keys(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, size)), np.uint64))


def prefix(keys: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the keys, common ones last, that any two texts which share `similarity` of their keys share one here.

    common: ascending. The order (common or not, then the key) is the same for all texts. If the least shared key stood in neither
    text's first n - ceil(similarity * n) + 1 keys, fewer than similarity * n of its n keys would be shared.
    """
    at = np.searchsorted(common, keys)
    last = at < len(common)
    last[last] = common[at[last]] == keys[last]
    least = math.ceil(similarity * len(keys) - 1e-9)
    return np.concatenate([keys[~last], keys[last]])[: len(keys) - max(1, least) + 1]


def sketched(text: str, size: int) -> tuple[bytes, int, bytes, bytes]:
    """A digest of the words, a fingerprint of the set of words, a sketch of the shingles in SKETCH bytes, and their hashes in order."""
    words = words_of(text)
    one = xxhash.xxh3_128_digest(b" ".join(words))
    distinct = set(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
    seen = sum((np.unpackbits(h[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(h), STEP)), np.zeros(BITS, np.int64))
    fp = int(np.packbits(2 * seen > len(h), bitorder="little").view("<i8")[0])
    h = np.unique(np.fromiter(map(xxhash.xxh32_intdigest, shingles(words, size)), np.uint32))
    least = np.full(SKETCH, 2**32, np.uint64)
    np.minimum.at(least, h % SKETCH, (h // SKETCH).astype(np.uint64))
    return one, fp, np.where(least < 2**32, 1 + least % 255, 0).astype(np.uint8).tobytes(), h.tobytes()


def alike(a: bytes, b: bytes) -> float:
    """The share of shingles in common, as estimated from two sketches (one permutation: a byte of each bin's least hash, 0 if empty)."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    some = int(((x > 0) | (y > 0)).sum())
    return int(((x == y) & (x > 0)).sum()) / some if some else 1.0


def shared(a: bytes, b: bytes) -> float:
    """The share of shingles in common, from all their hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _row(key: str, text: str):
    """Two digests of key and text, 128 bits together, as a Column of structs."""
    of = (F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit("b"), *of).alias("b"))


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (fp, node), sorted: pairs of rows that follow each other with one fp."""
    last = None
    for batch in batches:
        if batch.num_rows:
            fp, node = (batch.column(c).to_numpy() for c in range(2))
            if last is not None:
                fp, node = np.r_[last[0], fp], np.r_[last[1], node]
            same = np.flatnonzero(fp[1:] == fp[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(node[same]), pa.array(node[same + 1])], ["a", "b"])
            last = fp[-1:], node[-1:]


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, about HELD rows at once, cut between keys only."""
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= HELD:
            cols = [np.concatenate(c) for c in zip(*held)]
            ends = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            if len(ends):
                yield [c[: ends[-1] + 1] for c in cols]
                cols = [c[ends[-1] + 1 :] for c in cols]
            held, size = [cols], len(cols[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, pos, n), sorted by key and node, without repeats, of keys that several nodes have."""
    for key, node, pos, n in whole_keys(batches):
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, pos, n = key[new], node[new], pos[new], n[new]
        same = key[1:] == key[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in (key, node, pos, n)], ["key", "node", "pos", "n"])


def pairs_within(low: int, high: int, similarity: float):
    """Of rows (key, node, pos, n, root), sorted by key and node: pairs of one key, `low` to `high` - 1 rows apart, that aren't joined yet.

    Left out is only what can't share enough: too unlike in size, or with too little behind the key, which is the
    first that the two share or stands behind the first, and then a group of the first has the pair.
    """
    share = similarity / (1 + similarity)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, pos, n, root in whole_keys(batches):
            told = []
            for d in range(low, min(high, len(key))):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                i = i[root[i] != root[i + d]]
                j = i + d
                ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= share * (n[i] + n[j]) - 1e-6
                told.append(np.stack([node[i[ok]], node[j[ok]]]))
                if sum(t.shape[1] for t in told) > HELD:
                    yield batch_of(told)
                    told = []
            if told:
                yield batch_of(told)

    def batch_of(told):
        ab = np.unique(np.concatenate(told, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[0])), pa.array(np.ascontiguousarray(ab[1]))], ["a", "b"])

    return found


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and component_id of each document: groups of texts that share `similarity` of their shingles.

    At that similarity the fingerprints of shingles differ in ten bits or so, which no index can search; those of
    the sets of words differ in few. So the index finds the first candidates by a fingerprint of the word set, ten rows for each
    distinct one. Sketches of the
    shingles tell the clear edges, and all shingles of both texts the others. What that leaves apart is found by
    prefix keys: two texts at that similarity share one whatever the edit was. Round by round, pairs that stand
    further apart in the group of a key are looked at, up to the largest group; a pair is passed over only if its
    ends are joined by edges that were verified. Equal words (by 128 bits of their hash) are one text.
    """
    own, placed = _grouped(docs, size, similarity, key, text)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("key", "node").join(placed.join(ids, "root").select("node", "component_id"), "node").select(F.col("key").alias(key), "component_id")


def _grouped(docs: DataFrame, size: int, similarity: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Of each row its key, row and row2 (see _row) and node (a text); of each node its least key and root, equal in one group."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), _row(key, text).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    source = rows.select("key", F.col("row.a").alias("row"), F.col("row.b").alias("row2"), "text")
    kind = source.schema["key"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            texts = batch.column(3).to_pylist()
            told = [sketched(t, size) for t in texts]
            keys = [shingle_keys(words_of(t), size) for t in texts]
            one = np.frombuffer(b"".join(t[0] for t in told), np.int64).reshape(-1, 2)
            digests = [pa.array(np.ascontiguousarray(one[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *digests, pa.array([t[1] for t in told], pa.int64()), *(pa.array([t[c] for t in told], pa.binary()) for c in (2, 3)), pa.array([len(k) for k in keys], pa.int32()), pa.array([prefix(k, common, similarity).tobytes() for k in keys], pa.binary())], ["key", "row", "row2", "node", "more", "fp", "sketch", "shingles", "n", "keys"])

    rate = max(1, docs.count() // TOLD)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for t in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_keys(words_of(t), size).view(np.int64))], ["key"])

    # which shingles are common decides the work only, never what is found; so many texts, whatever the number of documents
    some = source.where(F.pmod("row", F.lit(rate)) == 0).select("row", "text").mapInArrow(tell, "key bigint")
    usual = some.groupBy("key").count().where(F.col("count") >= COMMON).select("key").toArrow()
    common = np.sort(usual.column(0).to_numpy().view(np.uint64))
    own = written(source.mapInArrow(make, f"key {kind}, row bigint, row2 bigint, node bigint, more bigint, fp bigint, sketch binary, shingles binary, n int, keys binary"), "sketches")
    nodes = written(own.groupBy("node").agg(F.min("key").alias("least"), F.min("fp").alias("fp"), (F.min("more") != F.max("more")).alias("clash")), "nodes")
    clash = written(nodes.where("clash").select("node", "clash"), "clash")
    if not clash.isEmpty():  # texts that share half of a digest get nodes of their own
        own = written(own.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "more")).otherwise(F.col("node"))).drop("clash"), "sketches")
        nodes = written(own.groupBy("node").agg(F.min("key").alias("least"), F.min("fp").alias("fp")), "nodes")
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp"), "fingerprints")
    found = links(first, NEAR_BITS, shared=2).select("a", "b")
    # texts of one fingerprint form a chain in the order of their nodes; where it's cut between tasks, prefix keys find the link
    chain = nodes.select("fp", "node").repartitionByRange("fp", "node").sortWithinPartitions("fp", "node").mapInArrow(neighbours, "a bigint, b bigint")
    found = written(found.union(chain).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")

    def judged(edges: DataFrame, column: str, judge) -> DataFrame:
        """a, b and the verdict of judge on the column of both ends."""
        # of the copies of a text only the first is looked for, so that they don't meet in one task
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least"), "node").toDF("end", "least")
        of = own.select("node", "key", column)
        held = of.join(ends, (F.col("node") == F.col("end")) & F.col("key").eqNullSafe(F.col("least")), "left_semi")
        held = written(held.select("node", column).dropDuplicates(["node"]), "ends")
        pairs = edges.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2):
                told = [judge(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.int32())], ["a", "b", "verdict"])

        return pairs.mapInArrow(verify, "a bigint, b bigint, verdict int")

    # five standard errors on either side of the bound are looked at closely: 2 sure, 1 unsure, 0 no
    wide = 5 * (similarity * (1 - similarity) / SKETCH) ** 0.5

    def verified(edges: DataFrame) -> DataFrame:
        rough = written(judged(edges, "sketch", lambda x, y: 2 if (r := alike(x, y)) >= similarity + wide else int(r >= similarity - wide)), "rough")
        close = judged(rough.where("verdict = 1").select("a", "b"), "shingles", lambda x, y: int(shared(x, y) >= similarity))
        return written(rough.where("verdict = 2").select("a", "b").union(close.where("verdict = 1").select("a", "b")), "verified")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            node, n = (batch.column(c).to_numpy() for c in (0, 2))
            keys = [np.frombuffer(k, np.int64) for k in batch.column(1).to_pylist()]
            many = np.array([len(k) for k in keys])
            pos = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(node, many)), pa.array(pos), pa.array(np.repeat(n, many))], ["key", "node", "pos", "n"])

    def by_key(rows: DataFrame) -> DataFrame:
        return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "node")

    # one row of each text is enough; rows that repeat the least key go with the others
    ones = own.select("key", "node", "keys", "n").join(nodes.select(F.col("node").alias("end"), "least"), (F.col("node") == F.col("end")) & F.col("key").eqNullSafe(F.col("least")), "left_semi")
    flat = ones.select("node", "keys", "n").mapInArrow(spread, "key bigint, node bigint, pos int, n int")
    keyed = written(by_key(flat).mapInArrow(shared_keys, flat.schema), "keyed")
    largest = keyed.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    edges, low = verified(found), 1
    while True:
        roots = written(components(edges), "roots")
        if low >= largest:
            break
        rows = keyed.join(roots, "node", "left").select("key", "node", "pos", "n", F.coalesce("root", "node").alias("root"))
        more = by_key(rows).mapInArrow(pairs_within(low, low * WIDER, similarity), "a bigint, b bigint")
        edges, low = edges.union(verified(written(more.distinct(), "pairs"))), low * WIDER
    return own, written(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the least key's (a null is the greatest), then the least digest of key and text.

    Rows of equal key and text are one row. A key stays in several rows if its texts are of different groups.
    """
    own, placed = _grouped(docs, size, similarity, key, text)
    first = own.join(placed.select("node", "root"), "node").groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "row2")).alias("first"))
    first = written(first.select(F.col("first.row").alias("__a"), F.col("first.row2").alias("__b")), "first")
    rows = docs.withColumn("__row", _row(key, text)).withColumns({"__row1": F.col("__row.a"), "__row2": F.col("__row.b")}).drop("__row")
    # the join and the removal of repeats share one shuffle of the documents
    return rows.join(first, (F.col("__row1") == F.col("__a")) & (F.col("__row2") == F.col("__b")), "left_semi").dropDuplicates(["__row1", "__row2"]).drop("__row1", "__row2")
