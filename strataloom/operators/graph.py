"""Connected components of an edge table by alternating star contractions.

Published as large-star / small-star: each round links every node's larger
neighbours to its smallest neighbour, then its smaller ones; the edge count
never grows, and few rounds end in one star for each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import kernels
from strataloom.sources.stage import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Staged, so that the join deals both of its sides anew and Spark can split a hub.
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = staged(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    near = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars: every node with its component's least node."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate([np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in held])
    nodes, numbers = np.unique(ends, return_inverse=True)
    roots = kernels.roots(len(nodes), *numbers.reshape(ends.shape).T)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["node", "label"])


def components(edges: DataFrame, most: int = 0) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the component's least node.

    Up to ``most`` edges, by count, are contracted in one task; beyond that, and
    always if ``most`` is 0, in rounds of stars.
    """
    if most and edges.count() <= most:
        return staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_contracted, "node long, label long"), "stars")
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = staged(_small_star(staged(_large_star(now), "edges")), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
