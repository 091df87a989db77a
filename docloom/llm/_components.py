"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import dropped, joined, saved

#: Nodes that a task holds before it emits what it knows of them and starts afresh.
MOST_NODES = 500_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace edges that a task reads by stars around the least node of each component among them."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> Iterator[pa.RecordBatch]:
        found = [(x, r) for x in list(parent) if x != (r := find(x))]
        for k in range(0, len(found), 50_000):
            part = found[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield from stars()
    yield from stars()


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns; returns (node, root) for every node of an edge, root being the least node reachable.

    A node with very many neighbours is no bottleneck: minima are pre-aggregated on the map side, and such a node's minimum
    is brought to its edges by a broadcast of bounded size (``joined``). A task holds a bounded number of nodes. Each step
    ends in a written table, so an executor's loss costs one step at most. No edge is ever sent to the driver.
    """
    a, b = edges.columns
    stars = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_local_forest, "u long, v long"), "stars")
    mark, n = None, stars.count()
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")).select("u", F.least("u", "m").alias("m"), "held"), "low")
        large = joined(both.where("v > u"), low, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")), "least")
        small = joined(large, least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(stars, low, large, least)
        stars, n = new, now[0]
        if now == mark:
            break
        mark = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def smallest(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): for each node of ``roots`` (a written table) the least ``least`` of its component's nodes, given
    as ``nodes`` (node, least). A component may hold any share of all nodes."""
    of = roots.join(nodes, "node").groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("held"))
    of = saved(of, "component")
    return joined(roots, of, "root", roots.count()).select("node", "component")
