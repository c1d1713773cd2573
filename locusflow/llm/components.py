"""Connected components with DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: a task's edges, a million at a time, become one edge
    from each node to the smallest node that they connect it with."""

    @lean
    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y = at[: a.size], at[a.size :]
            root = np.arange(nodes.size)
            while True:
                low = np.minimum(root[x], root[y])
                new = root.copy()
                np.minimum.at(new, root[x], low)
                np.minimum.at(new, root[y], low)
                while (new[new] != new).any():
                    new = new[new]
                if (new == root).all():
                    break
                root = new
            own = root != np.arange(nodes.size)
            return pa.RecordBatch.from_arrays([pa.array(nodes[root[own]]), pa.array(nodes[own])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, native: bool = True) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows these pointers to the roots by
    doubling, and replaces nodes by roots, so components shrink at least by half a round. Minima
    are aggregated before the shuffle; joins read written tables, so Spark splits hot hubs. Loops,
    repeated edges and null ends are ignored. Unless native, nodes must be whole numbers, and edges
    are contracted within tasks first."""
    left, right = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rest = edges.where("a is not null and b is not null and a <> b").select(left, right).distinct()
    rest = materialise(rest if native else stars(rest), "cc-edges")
    labels = None
    while True:
        both = rest.select(F.col("a").alias("x"), F.col("b").alias("y")).union(rest.select(F.col("b").alias("x"), F.col("a").alias("y")))
        parents = materialise(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")), "cc-parents")
        while True:
            above = parents.select(F.col("x").alias("p"), F.col("p").alias("q"))
            over = parents.select(F.col("x").alias("q"), F.col("p").alias("r"))
            step = materialise(parents.join(above, "p").join(over, "q").select("x", F.col("r").alias("p"), (F.col("q") != F.col("r")).alias("moved")), "cc-parents")
            parents = step.select("x", "p")
            if step.where("moved").isEmpty():
                break
        to = parents.select(F.col("x").alias("component"), "p")
        labels = parents.select(F.col("x").alias("node"), F.col("p").alias("component")) if labels is None else materialise(labels.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
        a, b = parents.select(F.col("x").alias("a"), F.col("p").alias("pa")), parents.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = rest.join(a, "a").join(b, "b").where("pa <> pb")
        rest = materialise(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if rest.isEmpty():
            return labels


def merged_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, component) after more links (a, b); only components are connected anew."""
    if labels is None:
        return connected_components(links, native=False)
    ends = links
    for c in ("a", "b"):
        own = labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        ends = ends.join(own, c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    joined = connected_components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), native=False)
    nodes = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component")))
    nodes = nodes.groupBy("node").agg(F.min("component").alias("component"))  # a component is never above its nodes
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialise(nodes.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
