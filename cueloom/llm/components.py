"""Connected components of an edge table by alternating star contraction.

Each round joins every node's edges to the least node it sees, first on the larger side of a node,
then on the smaller; the edge table shrinks to stars around the least node of each component in a
number of rounds logarithmic in the longest path.  Every round is written to the shared folder.
No neighbour list is ever collected; a node with a third of all edges is one skewed join key.
A table of at most ONCE edges, 16 bytes each, is contracted by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cueloom.shared import pin

ONCE = 500_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the least of their component, and that least node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.concatenate(c) for c in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), strict=True)]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in contracted(*ends)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, root bigint")


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node ``m`` among u and the v of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), any order, repeats and loops allowed -> (node, root): root is the least node of the
    component.  Nodes are long integers; edges with a null end are no edges; nodes without another
    end are not listed."""
    held = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held, before = pin(held, "edges"), None
    if held.count() <= ONCE:
        return pin(_at_once(held), "edges")
    while True:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        # Where a node's neighbours are all smaller, its least neighbour becomes the centre of them all.
        seen = _least(down)
        small = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            seen.select("u", F.col("m").alias("v"))
        )
        held = pin(small.filter("u <> v").distinct(), "edges")
        state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
