"""Connected components by alternating large and small stars, without collecting edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Edges that a task contracts at once. So few edges or fewer are contracted by one task, which is all they need.
FOREST_EDGES = 200_000


def _contracted(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, contracted FOREST_EDGES at a time: each node with the least node of its part."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, FOREST_EDGES):
            part = batch.slice(lo, FOREST_EDGES)
            if n + part.num_rows > FOREST_EDGES:
                yield _contracted(*(np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1)))
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield _contracted(*(np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1)))


def components(spark: SparkSession, edges: DataFrame, n_edges: int) -> DataFrame:
    """node and root, the least node it is linked with, for each node of n_edges edges (x, y) that isn't a root itself.

    Tasks first contract what they hold. Then a large star links every larger neighbour of a node with the
    node's least neighbour, a small star every smaller one; each turn is a minimum per node, combined before
    the shuffle, and a join. Turns go on until every node hangs on its root.
    """
    pairs = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).where("u != v")
    if n_edges <= FOREST_EDGES:
        done = tables.written(spark, pairs.coalesce(1).mapInArrow(_forest, "u long, v long"))
        return done.select(F.col("u").alias("node"), F.col("v").alias("root"))
    turn = tables.written(spark, pairs.mapInArrow(_forest, "u long, v long").distinct())
    while True:
        both = turn.unionByName(turn.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        large = tables.written(spark, large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))  # in large, v < u
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = tables.written(spark, small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        tables.drop(turn, large)
        ends = after.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        by_node = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
        # done when every node has one edge, to a node without any
        if not by_node.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0))).alias("open")).first()["open"]:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        turn = after
