"""Connected components by alternating large-star and small-star contraction, all in DataFrame operations.

Each round is two shuffles of the edges that are left; the number of rounds grows with the logarithm of the longest
path. Once few enough edges are left for one task's memory, whatever the input, that task joins them up. A node with very many neighbours would bring them all into one task, so the few such nodes' minima are broadcast
instead. Every round's edges are a table in the shared folder, so lineage stays short and lost executors cost one round;
the table of the round before goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import forget, stage

HUBS = 10_000
"""A node with more than one in half so many of the edges is a hub; there are at most this many."""


FEW = 1 << 19
"""So many edges, 8 MB, are joined up in one task."""


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def _star(pairs: DataFrame, large: bool, edges: int) -> DataFrame:
    """One contraction. pairs: distinct (u, v), u > v, edges of them."""
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if edges <= HUBS:
        joined = both.join(least, "u")
    else:
        least = stage(least, "least")
        hub = F.col("n") > max(HUBS, 2 * edges // HUBS)
        hubs = F.broadcast(least.filter(hub))  # at most HUBS rows: all counts together are twice the edges
        joined = both.join(hubs.select("u"), "u", "left_anti").join(least.filter(~hub), "u").unionByName(both.join(hubs, "u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable. No edges give no rows."""
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = stage(pairs, "edges")
    before = _digest(pairs)
    whole = pairs.schema["u"].dataType.simpleString() in ("bigint", "int")
    while before[0]:
        if whole and before[0] <= FEW:
            return _in_one_task(pairs)
        half = _star(pairs, True, before[0])
        if before[0] > HUBS:
            half = stage(half, "edges")
        turned = stage(_star(half, False, before[0]), "edges")
        forget(pairs, half if before[0] > HUBS else None)
        pairs = turned
        after = _digest(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _in_one_task(pairs: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v)."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            u, v = table["u"].to_numpy(), table["v"].to_numpy()
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            low = local_forest(at[: len(u)], at[len(u) :], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, table["u"].type), pa.array(names[low], table["u"].type)], names=["node", "component"])

    return pairs.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over links a-b."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, low[a], m)
        np.minimum.at(low, low[b], m)
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            break
    return low
