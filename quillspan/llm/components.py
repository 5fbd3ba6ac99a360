"""Connected components of an edge table, with union-find in the workers and star operations across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .workers import bounded, tidy


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch: its edges become (node, smallest node of its tree in the batch)."""
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        top = np.array([root(x) for x in range(len(nodes))], np.int64)
        own = top != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[top[own]], pa.int64())], names=["u", "v"])


def _climbed(edges: DataFrame) -> DataFrame:
    """Each node's edges to smaller ones become one edge to the smallest, and edges among the others and it.

    Rows are grouped by the larger node, which after the forests has at most as many edges as
    there were batches: a hub, being the smaller node, never gathers its edges.
    """
    up = edges.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    pairs = F.transform("vs", lambda v, i: F.struct(F.when(i == 0, F.col("u")).otherwise(v).alias("u"), F.get("vs", F.lit(0)).alias("v")))
    return up.select(F.explode(pairs).alias("e")).select("e.u", "e.v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (u, v), the smallest node it is connected with.

    Nulls and loops are ignored. First every node gets one parent, a smaller one, which merges
    trees; then parents are replaced by their parents until all are roots. Rounds are cut by
    written tables, and both sides of the joins are such tables, so that a hub can be split.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(bounded(edges).mapInArrow(tidy(_forest), "u long, v long").distinct(), "forest")
    while edges.groupBy("u").count().where("count > 1").limit(1).count():
        edges = written(_climbed(_climbed(edges)), "parents")
    while True:
        above = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jumped = written(edges.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "jumped")
        edges = jumped.select("u", "v")
        if not jumped.where("moved").limit(1).count():
            break
    tops = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return edges.unionByName(tops).select(F.col("u").alias("node"), F.col("v").alias("component"))
