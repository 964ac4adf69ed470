"""Connected components of an undirected pair graph by star contraction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalume.plans.tables import saved


def _larger_first(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component when edges from a to b are added; `root` has it for those before."""
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        root = root.copy()
        np.minimum.at(root, high, low)
        while True:  # every node points at the end of its path
            further = root[root]
            if (further == root).all():
                break
            root = further


def star_of(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are not the least of their component."""
    some = np.flatnonzero(root != np.arange(len(root)))
    return some, root[some]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of these edges that are not the least of their component: a star for each component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    node, root = star_of(joined(np.arange(len(nodes)), at[: len(u)], at[len(u) :]))
    return nodes[node], nodes[root]


def contracted(edges: DataFrame, held: int = 1_000_000, roots: bool = False) -> DataFrame:
    """(u, v) with the same components as edges(u, v): each task leaves one star for each component of `held` of its edges at a time. With `roots`, also a row (root, root) for each."""

    def run(batches):
        kept: list[np.ndarray] = []
        size = 0
        for batch in batches:
            kept.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size >= held:
                kept = [np.stack(forest(*np.concatenate(kept, 1)))]
                size = kept[0].shape[1]
                if size >= held // 2:  # little to contract
                    yield made(kept[0])
                    kept, size = [], 0
        if kept:
            yield made(np.stack(forest(*np.concatenate(kept, 1))))

    def made(x):
        x = np.concatenate((x, np.tile(np.unique(x[1]), (2, 1))), 1) if roots else x
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def star_contraction(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, save: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is the least node reached.

    Each round is a large-star and a small-star step (Kiveris et al., SoCC 2014): both are one grouped
    minimum and one join, and their output is never larger than their input. A round's edges are written
    to the shared folder, by `save`. The loop ends when every edge points straight at the least node of its component.
    Before the first round each task contracts its own edges to stars, so runs and groups that lie together are
    not shuffled as chains or pairs. Self-loops and rows with a null end are ignored; no edges give no rows.
    """
    given = edges.select(*_larger_first(F.col(src).cast("long"), F.col(dst).cast("long"))).where("u <> v")
    # written as they lie: edges made in Python would need two workers a task, and a shuffle would part those that lie together
    e = save(contracted(save(given, "edges")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and in = 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("merge"), "u")
        e = save(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def components_by_roots(edges: DataFrame, src: str = "src", dst: str = "dst", save: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """(node, component) as star_contraction, for edges of which those of a component lie mostly together.

    Tasks contract their own edges to stars, and each node is dealt out once, with the roots of all its stars. The least of
    them stands for the node; the others are edges of a graph of roots, and only that one goes through rounds.
    """
    given = edges.select(*_larger_first(F.col(src).cast("long"), F.col(dst).cast("long"))).where("u <> v")
    stars = contracted(save(given, "edges"), roots=True).repartition("u").distinct()
    nodes = save(stars.withColumn("least", F.min("v").over(W.partitionBy("u"))), "nodes")
    found = star_contraction(nodes.where("v <> least"), "v", "least", save=save).withColumnRenamed("node", "least")
    return nodes.where("v = least").select(F.col("u").alias("node"), "least").join(found, "least", "left").select("node", F.coalesce("component", "least").alias("component"))
