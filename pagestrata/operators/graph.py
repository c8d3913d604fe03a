"""Connected components of an edge table, without collecting it.

Each task first contracts its own edges by union-find, a bounded number of nodes at a time; what the forests leave is
dealt to tasks of up to ``PER_TASK`` edges and contracted once more; large-star and small-star rounds go on until all components are
stars, which one aggregation tells. Rounds aggregate with map-side minima and join back, so a hub of any
degree neither gathers in one task nor widens a row. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.session import checkpointed

#: Nodes that a task's forest holds before it is passed on: some 40 MB.
MOST = 250_000
PER_TASK = 100_000


def _contract(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter((find(int(x)) for x in nodes), np.int64, len(nodes))
        below = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(roots[below])], ["u", "v"])

    for batch in batches:
        for i in range(0, batch.num_rows, 4_096):
            part = batch.slice(i, 4_096)
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= most:
                yield out()
                parent.clear()
    yield out()


def components(spark: SparkSession, edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node."""
    schema = "u long, v long"
    forests = checkpointed(spark, edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract, schema))
    tasks = max(1, -(-forests.count() // per_task))
    edges = checkpointed(spark, forests.coalesce(tasks).mapInArrow(_contract, schema).repartition("u", "v").distinct())
    while not _stars(edges):
        edges = _round(spark, edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, and none of its upper ends has one: one aggregation."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).agg(F.count_if(F.expr("up > 1 OR (up = 1 AND low = 1)"))).first()[0] == 0


def _round(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Minima are tables of their own: a join of two plain exchanges is one whose hot keys the runtime can split.
    low = checkpointed(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = checkpointed(spark, both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    low = checkpointed(spark, large.groupBy("u").agg(F.min("v").alias("m")))
    met = large.join(low, "u")
    small = met.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
    return checkpointed(spark, small)
