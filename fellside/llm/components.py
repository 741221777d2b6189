"""Connected components of a graph that no task and no driver holds whole.

Distributed union-find: each task first unites what its own edges connect, in chunks of bounded size, and
passes on a forest (a node and the least node of its tree) instead of all edges. The forests are then merged
by rounds of the large-star and small-star steps, each two aggregations with map-side combining and two
joins, until every node points at the least node of its component. A node that many edges share is a join key
that adaptive execution may split; no group is gathered anywhere. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written

CHUNK = 1 << 18
FOREST = "node long, root long"


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes other than roots, and the least node of the tree of each, for the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        # hang the roots of both ends below the lesser one, then let every node point at its root
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


class Forest:
    """Takes edges in pieces, and gives them back as forests of at most about ``CHUNK`` edges."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.parts, self.size = chunk, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(a):
            return
        self.parts.append((a, b))
        self.size += len(a)
        if self.size > self.chunk:
            x, y = self._united()
            if len(x) > self.chunk // 2:
                yield self._batch(x, y)
                self.parts, self.size = [], 0
            else:
                self.parts, self.size = [(x, y)], len(x)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield self._batch(*self._united())

    def _united(self):
        return local_forest(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))

    @staticmethod
    def _batch(x, y) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["node", "root"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        yield from forest.add(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
    yield from forest.rest()


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (node, root), root < node."""
    least = edges.select(F.col("node").alias("at"), F.col("root").alias("to")).union(edges.select("root", "node")).groupBy("at").agg(F.min("to").alias("low"))
    least = least.select("at", F.least("at", "low").alias("low"))
    large = edges.join(least, edges.root == least.at).select("node", F.col("low").alias("root")).distinct()
    low = large.groupBy("node").agg(F.min("root").alias("low"))
    turned = large.join(low.withColumnRenamed("node", "at"), F.col("node") == F.col("at"))
    small = turned.where(F.col("root") != F.col("low")).select(F.col("root").alias("node"), F.col("low").alias("root"))
    return small.union(low.select("node", F.col("low").alias("root"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns, any order, repeats and loops allowed. Rows (node, root) for every node that an
    edge joins to another: root is the least node of its component. A component's least node has a row too."""
    a, b = edges.columns
    clean = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where(F.col("node").isNotNull() & F.col("root").isNotNull() & (F.col("node") != F.col("root")))
    now, path = written(clean.mapInArrow(_unite, FOREST).distinct(), "forest")
    while True:
        # stars: every node has one root, and no root is itself a node
        seen = now.select(F.col("node").alias("at"), F.lit(1).alias("n"), F.lit(0).alias("r")).union(now.select("root", F.lit(0), F.lit(1)))
        seen = seen.groupBy("at").agg(F.sum("n").alias("n"), F.max("r").alias("r"))
        if seen.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("r") > 0))).isEmpty():
            break
        nxt, new_path = written(_star(now), "forest")
        drop_path(edges.sparkSession, path)
        now, path = nxt, new_path
    return now.union(now.select(F.col("root").alias("node"), "root").distinct())
