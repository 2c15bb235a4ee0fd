"""Connected components by contraction within partitions and pointer jumping between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch

PART_EDGES = 1 << 19  # most edges that one task contracts, on average


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph that aren't the least of their component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[x], label[y])
        np.minimum.at(new, label[y], label[x])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    low = label != np.arange(len(nodes))
    return nodes[low], nodes[label[low]]


def _contract(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for i in range(0, len(node), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 50_000], pa.int64()), pa.array(root[i : i + 50_000], pa.int64())], ["node", "root"])


def components(edges: DataFrame, n_edges: int, scratch: Scratch, name: str) -> DataFrame:
    """node, root: the least id that a node is joined with, for all nodes but those least ones; edges: a, b (long).

    The edges are dealt into parts of about PART_EDGES.  Each part becomes a
    forest of stars, so a round keeps no more edges than nodes; a node's stars
    then meet in the part of that node, and pointers jump to their root's root.
    The rounds grow with the logarithm of the longest chain of parts; one part
    is done after the first.  Only counts come to the driver.
    """
    edges = edges.select("a", "b").where("a <> b")
    step = 0
    while True:
        step += 1
        n = max(1, -(-n_edges // PART_EDGES))
        dealt = edges.coalesce(1) if n == 1 else edges.repartition(n, F.greatest("a", "b"))
        forest = scratch.put(dealt.mapInArrow(_contract, "node long, root long"), f"{name}-{step}-forest", F.count("*"))
        n_edges = scratch.observed
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
        if n == 1:
            return forest
        least = forest.groupBy("node").agg(F.min("root").alias("low"))
        above = least.select(F.col("node").alias("low"), F.col("low").alias("up"))
        jumped = forest.join(least, "node").join(above, "low", "left")
        edges_of = F.array(F.struct(F.col("node").alias("a"), F.coalesce("up", "low").alias("b")), F.struct(F.col("root").alias("a"), F.col("low").alias("b")))
        moved = (F.col("root") != F.col("low")) | F.col("up").isNotNull()
        after = scratch.put(jumped.select("node", "root", moved.alias("moved"), edges_of.alias("edges")), f"{name}-{step}", F.count_if("moved"))
        scratch.drop(f"{name}-{step}-forest")
        if not scratch.observed:
            return after.select("node", "root")
        edges = after.select(F.inline("edges")).where("a <> b")
        n_edges *= 2
