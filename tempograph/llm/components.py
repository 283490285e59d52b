"""Connected components by alternating star contraction, as Spark joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node that is not the least one of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (onward := root[root]).tobytes() != root.tobytes():
            root = onward
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def star_components(edges: DataFrame, scratch: Scratch, label: str = "stars", here: int = 0) -> DataFrame:
    """(node, root) for each node of an undirected edge table (u, v); root is the component's least node.

    Large star: a node's larger neighbours move to its least neighbour.  Small
    star: its smaller ones do.  Both keep the components, neither adds edges
    beyond one per node, and a number of rounds logarithmic in the component
    size leaves one star each.  Every round is written to the shared folder.
    Up to ``here`` edges of whole numbers are contracted by the driver, without
    a round: the same stars.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = scratch.save(ordered, f"{label}-0")
    if here and current.count() <= here:
        held = current.toArrow()
        node, root = roots_of(*(held.column(c).to_numpy() for c in ("u", "v")))
        scratch.drop(f"{label}-0")
        return scratch.spark.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())}))
    state, k = None, 0
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = scratch.save(small.union(down.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{k + 1}")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{k}")
        current, k = following, k + 1
        if now == state:
            break
        state = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
