"""Connected components of an edge table, by contraction on the executors.

Each round every node hooks to the neighbour of least rank, and edges move to where their ends went. Ranks are
hashes, so chains break up and the nodes left shrink by a constant share. What fits one task is closed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task closes (16 bytes each); more are contracted first.
TASK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least labels of nodes 0..n-1, and the positions of edges a-b that joined two trees (earlier edges first)."""
    label = np.arange(n) if label is None else label
    used = []
    left = np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        tops, first = np.unique(high, return_index=True)
        up = np.arange(n)
        up[tops] = low[first]
        used.append(left[first])
        while (further := up[up] != up).any():
            up[further] = up[up[further]]
        label = up[label]
    return label, np.concatenate(used) if used else np.zeros(0, np.int64)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = list(batches)
    if not tables:
        return
    whole = pa.Table.from_batches(tables)
    a, b = (whole.column(c).to_numpy() for c in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, _ = forest(at[: len(a)], at[len(a) :], len(nodes))
    for k in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(nodes[label[k : k + 100_000]])], ["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, root (bigint) of every node that has an edge to another; equal roots, same component. edges: a, b."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("to"))
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moved = None
    while (n := edges.count()) > task_edges:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least(rank("a"), "least").alias("least"))
        hooks = written(hooks.select(F.col("a").alias("node"), F.col("least.to").alias("to")), "hooks")
        ends = edges.join(hooks.toDF("a", "x"), "a").join(hooks.toDF("b", "y"), "b")
        moved = hooks if moved is None else moved.join(hooks.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        moved = written(moved, "moved")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    roots = edges.coalesce(1).mapInArrow(_close, "node bigint, root bigint")
    if moved is None:
        return roots
    roots = written(roots, "roots")
    return moved.join(roots.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
