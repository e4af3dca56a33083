"""Quality classifier by co-training (operator 5).

Two logistic classifiers see a document through views that share nothing: the text (hashed pairs of bytes and hashed words, the
share of marks and the like, and how words repeat) and what is known of the page without its text (language, source, both
together, and declared size). Each round, each view scores every document without a label, and its most
confident ones of either class, by probabilities that were calibrated on labelled documents that neither view learned from, are
pseudo-labels for the other view. At the end both views are calibrated again, and a third logistic function of the two calibrated
log odds scores all.

Bounds of the fit: about MAX_LABELLED labelled rows at most (drawn by a hash of id and views, equal ones once; every fourth calibrates) and
MOST_CONFIDENT pseudo-labels for each view, class and round, sought among all documents.

Null text is empty text, other nulls are values of their own. Labels of one document are averaged; a half is good.
Null labels, and labels of no document, count for nothing. Without labels of both classes nothing is learned: every
score is the share of good labels (1 without labels). A document is kept if its score is 0.5 or more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, written

MAX_LABELLED, MOST_CONFIDENT, ROUNDS, SURE, RIDGE = 20_000, 200, 3, 0.9, 1.0
#: Cells that pairs of bytes, words, languages, sources, both together and sizes fall into.
PAIRS, WORDS, LANGS, SOURCES, BOTH, SIZES = 128, 256, 16, 64, 64, 16
_LOWER, _UPPER, _DIGIT, _BLANK = (np.array([chr(b) in s for b in range(256)]) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r"))
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[_UPPER] += 32
_MARKS = ~(_LOWER | _UPPER | _DIGIT | _BLANK) & (np.arange(256) < 128)
#: Weights of a word's bytes by their place, for its hash.
_PLACE = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _cells(h: np.ndarray, n: int) -> np.ndarray:
    """Roots of the shares of hashes in each of n cells (a power of two), so that small shares count."""
    at = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)
    return np.sqrt(np.bincount(at, minlength=n) / max(1, len(h)))


def text_view(text: str) -> np.ndarray:
    """Hashed pairs of bytes and words in lower case, shares of kinds of characters, and how words repeat; in 255ths."""
    raw = np.frombuffer(text.encode(), np.uint8)
    small = _SMALL[raw]
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    inside = ~_BLANK[small]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(raw) else np.zeros(0, np.int64)
    if len(starts):
        word = np.cumsum(np.r_[inside[0], inside[1:] & ~inside[:-1]]) - 1
        at = np.flatnonzero(inside)
        parts = (small[at].astype(np.uint64) + np.uint64(1)) * _PLACE[(at - starts[word[at]]) % 64]
        words = np.add.reduceat(parts, np.searchsorted(at, starts))
        pairs = words[1:] * np.uint64(31) + words[:-1]
    else:
        words = pairs = np.zeros(0, np.uint64)
    m = max(1, len(words))
    two = small[1:].astype(np.uint64) * np.uint64(256) + small[:-1]
    shares = np.sqrt(np.array([counts[_UPPER].sum(), counts[_DIGIT].sum(), counts[_MARKS].sum(), counts[_BLANK].sum(), counts[10], counts[128:].sum()]) / n)
    rest = [len(np.unique(words)) / m, len(np.unique(pairs)) / m, min(1.0, len(raw) / m / 20), float(len(words) > 0)]
    return np.round(255 * np.r_[_cells(two, PAIRS), _cells(words, WORDS), shares, rest]).astype(np.uint8)


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language, source, both together and the declared size as cells; no part of the text."""
    told = np.zeros(LANGS + SOURCES + BOTH + SIZES, np.uint8)
    size = 0 if n_chars is None else 1 + min(SIZES - 2, max(0, n_chars).bit_length())
    at = 0
    for value, n in ((lang, LANGS), (source, SOURCES), ((lang, source), BOTH)):
        told[at + zlib.crc32(repr(value).encode()) % n] = 255
        at += n
    told[at + size] = 255
    return told


VIEWS = (len(text_view("")), len(meta_view(None, None, 0)))


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights and intercept, by Newton steps; both classes weigh the same."""
    x = np.c_[x, np.ones(len(x))].astype(np.float32)
    weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x.T * (weight * p * (1 - p) + 1e-9).astype(np.float32)) @ x
        step = np.linalg.solve(bend.astype(np.float64) + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Weights of the two views and of the calibrated combination; prior alone if nothing was learned."""

    prior: float
    views: list[np.ndarray] | None = None
    calibration: list[np.ndarray] | None = None
    both: np.ndarray | None = None

    def scores(self, x: list[np.ndarray]) -> list[np.ndarray]:
        """Of the text view, the metadata view and both."""
        if self.views is None:
            return [np.full(len(x[0]), self.prior)] * 3
        odds = [c[0] * _odds(_scaled(v), w) + c[1] for v, w, c in zip(x, self.views, self.calibration)]
        return [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, _odds(np.stack(odds, 1), self.both))]


@dataclass
class Columns:
    key: str = "doc_id"
    text: str = "text"
    lang: str = "lang"
    source: str = "source"
    n_chars: str = "n_chars"

    def of(self, docs: DataFrame) -> list:
        return [F.coalesce(F.col(f"`{self.text}`"), F.lit("")).alias("text"), F.col(f"`{self.lang}`").cast("string").alias("lang"), F.col(f"`{self.source}`").cast("string").alias("source"), F.col(f"`{self.n_chars}`").cast("bigint").alias("n_chars")]


def _views(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    text, lang, source, n = (batch.column(at + k).to_pylist() for k in range(4))
    return [np.stack([text_view(t) for t in text]), np.stack([meta_view(*r) for r in zip(lang, source, n)])]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / 255


def features(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """key and both views as bytes, in the shared folder."""
    rows = docs.select(F.col(f"`{columns.key}`").alias("key"), *columns.of(docs))
    kind = rows.schema["key"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in _views(batch, 1))], ["key", "x0", "x1"])

    return written(rows.mapInArrow(make, f"key {kind}, x0 binary, x1 binary"), "views")


def _matrix(rows: list[bytes], view: int) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, VIEWS[view]))


def confident(unlabelled: DataFrame, weights: list[np.ndarray], most: int) -> list[list]:
    """For each view, rows that it is surest of, by calibrated weights: at most `most` of each class, ties by key and views."""
    kind = unlabelled.schema["key"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the surest of a task's rows, at most `most` for each view and class
        held: dict[tuple[int, int], list] = {(v, y): [] for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            for v in (0, 1):
                p = 1 / (1 + np.exp(-np.clip(_odds(_matrix([r[1 + v] for r in rows], v), weights[v]), -30, 30)))
                for y, sure in ((1, p), (0, 1 - p)):
                    new = [(-float(sure[k]), rows[k]) for k in np.flatnonzero(sure >= SURE)]
                    held[v, y] = sorted(held[v, y] + new, key=lambda r: (r[0], r[1]))[:most]
        out = [(v, y, -s, *r) for (v, y), told in held.items() for s, r in told]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), batch.schema.field(0).type, pa.binary(), pa.binary()))], ["view", "y", "sure", "key", "x0", "x1"])

    found = written(unlabelled.where("key is not null").mapInArrow(pick, f"view int, y int, sure double, key {kind}, x0 binary, x1 binary"), "confident")
    return [[r for y in (0, 1) for r in found.where((F.col("view") == v) & (F.col("y") == y)).orderBy(F.desc("sure"), "key", "x0", "x1").limit(most).collect()] for v in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), label: str = "quality", max_labelled: int = MAX_LABELLED, most: int = MOST_CONFIDENT, rounds: int = ROUNDS) -> Model:
    told = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{columns.key}`").alias("key")).agg(F.avg((F.col(f"`{label}`") > 0).cast("int")).alias("y"))
    views = features(docs, columns)
    told = written(told, "labels")
    # one shuffle of the views by key, whatever the size of the labels; the rounds then only read
    views = written(views.join(told.hint("shuffle_hash"), "key", "left"), "labelled")
    # drawn by a hash, so that no task sends more than its share to the driver, and equal rows once
    known = views.where("y is not null").withColumn("h", F.pmod(F.xxhash64("key", "x0", "x1"), F.lit(1 << 40)))
    share = min(1.0, max_labelled / max(1, known.count()))
    rows = known.where(F.col("h") < share * (1 << 40)).dropDuplicates(["h"]).orderBy("h").collect()
    y = np.array([float(r["y"] >= 0.5) for r in rows])
    prior = float(y.mean()) if len(y) else 1.0
    if len(y) < 8 or y.min() == y.max():
        return Model(prior)
    held = np.array([r["h"] % 4 == 0 for r in rows])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    x = [_matrix([r[f"x{v}"] for r in rows], v) for v in (0, 1)]
    train = [(x[v][~held], y[~held]) for v in (0, 1)]

    def calibrated() -> tuple[list[np.ndarray], list[np.ndarray]]:
        weights = [logistic(*train[v]) for v in (0, 1)]
        told = [logistic(_odds(x[v][check], weights[v])[:, None], y[check], 1e-2) for v in (0, 1)]
        return weights, [c if c[0] > 0 else np.zeros(2) for c in told]  # a view that tells nothing says a half

    weights, calibration = calibrated()
    unlabelled = views.where("y is null").select("key", "x0", "x1")
    for _ in range(rounds):
        sure = [np.r_[c[0] * w[:-1], c[0] * w[-1] + c[1]] for w, c in zip(weights, calibration)]
        for v, more in enumerate(confident(unlabelled, sure, most)):  # what a view is sure of teaches the other
            if more:
                o = 1 - v
                train[o] = (np.r_[x[o][~held], _matrix([r[f"x{o}"] for r in more], o)], np.r_[y[~held], [r["y"] for r in more]])
        weights, calibration = calibrated()
    odds = np.stack([c[0] * _odds(x[v][check], w) + c[1] for v, (w, c) in enumerate(zip(weights, calibration))], 1)
    return Model(prior, weights, calibration, logistic(odds, y[check], 1e-2))


def score(docs: DataFrame, model: Model, columns: Columns = Columns()) -> DataFrame:
    """key, p_text, p_meta, score and keep of every document."""
    rows = docs.select(F.col(f"`{columns.key}`").alias("key"), *columns.of(docs))
    kind = rows.schema["key"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            p = model.scores(_views(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= 0.5)], [columns.key, "p_text", "p_meta", "score", "keep"])

    return rows.mapInArrow(rate, f"`{columns.key}` {kind}, p_text double, p_meta double, score double, keep boolean")


def kept(docs: DataFrame, model: Model, columns: Columns = Columns()) -> DataFrame:
    """The documents that the model keeps, row for row."""
    names = [f"__view{k}" for k in range(4)]
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = [n + "_" for n in names]
    wide = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(columns.of(docs), names)])
    n = len(docs.columns)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, n):
            stay = model.scores(_views(batch, n))[2] >= 0.5
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)], batch.schema.names[:n]).filter(pa.array(stay))

    return wide.mapInArrow(choose, T.StructType([f for f in docs.schema.fields]))
