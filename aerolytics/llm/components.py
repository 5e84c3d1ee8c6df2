"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

Each round is two aggregations with partial sums and two joins; rounds grow with the logarithm of the longest path.
Edges are written to the shared folder after every round, and the older round is deleted. Nothing but one row of
counts goes to the driver. Up to LOCAL_EDGES edges one task joins by itself, with the same result: rounds over so few
would mean thousands of tasks that the driver keeps account of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: 16 MB.
LOCAL_EDGES = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all edges: the least label of both ends goes to their roots, and labels follow theirs, until none changes."""
    got = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
    ids, at = np.unique(np.concatenate([np.empty((2, 0), np.int64), *got], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    near = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every id on an edge (columns a, b)."""
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).first())
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if now.count() <= LOCAL_EDGES:
        found = written(now.coalesce(1).mapInArrow(_joined, "id long, component long"), "components")
        drop_written(now)
        return found
    seen = None
    while True:
        new = written(_small_star(_large_star(now)), "edges")
        got = mark(new)
        drop_written(now)
        now = new
        if got == seen or got[0] == 0:
            break
        seen = got
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
