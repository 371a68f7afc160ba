"""Connected components of an edge table by contraction.

Edges are first united inside each partition: a partition of any size is
replaced by a forest of its own, every node pointing to the smallest node that the
partition connects it with.  While more than SMALL edges are left, rounds of
contraction follow: every node points to its smallest neighbour if that is
smaller; the pointers (which always lead to smaller ids) are followed to their
ends by doubling, edges are renamed to those ends, and loops and repeats go.
Since every node but a local minimum is merged, a few rounds are enough.  What
is left within SMALL edges - a bound that does not grow with the data - is
united in one task.

All state is tables: each step is stored in the shared checkpoint folder with
as many partitions as its rows need, the driver sees counts only, and they are
counted while the step is written.  Tables are stored before they are joined, so
the joins are plain ones whose hot keys (the centre of a large star) Spark can
split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import counted

#: Edges that one task unites.
SMALL = 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that the edges connect each with), without the nodes that are their own smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    head = np.arange(len(ids))
    while True:
        low = np.minimum(head[x], head[y])
        new = head.copy()
        # the heads of an edge's ends, and the ends, point to the smaller one
        for end in (head[x], head[y], x, y):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == head).all():
            break
        head = new
    moved = np.flatnonzero(head != np.arange(len(ids)))
    return ids[moved], ids[head[moved]]


def _united(edges: DataFrame) -> DataFrame:
    """(a, b): the forest of each partition, a being the smaller end."""

    def run(batches):
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            node, head = forest(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(head, pa.int64()), pa.array(node, pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _ends(parents: DataFrame, rows: int) -> DataFrame:
    """(node, parent) with every parent replaced by the end of its chain."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        found, moved = counted(parents.join(up, "parent", "left")
                               .select("node", F.coalesce("above", "parent").alias("parent"),
                                       F.col("above").isNotNull().alias("moved")), rows, F.col("moved"))
        parents = found.select("node", "parent")
        if not moved:
            return parents


def _renamed(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    named = names.select(F.col("node").alias(col), F.col("parent").alias("__to"))
    return (df.join(named, col, "left").withColumn(col, F.coalesce("__to", col)).drop("__to"))


def _once(edges: DataFrame, rows: int | None) -> tuple[DataFrame, int]:
    """Edges from the smaller to the larger end, united within their partitions, and how many there are."""
    ordered = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return counted(_united(ordered), rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names, component the smallest node reachable.

    Nodes that only edges to themselves name are left out.
    """
    edges, n = _once(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")), None)
    names = None
    while n:
        if n <= SMALL:
            last, rows = counted(_united(edges.coalesce(1)), n)
            parents = last.select(F.col("b").alias("node"), F.col("a").alias("parent"))
        else:
            # an edge's smaller end is a neighbour of its larger end that it can point to
            heads, rows = counted(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), n)
            parents = _ends(heads, rows)
        if names is None:
            names, total = parents, rows
        else:
            names, total = counted(_renamed(names, parents, "parent").unionByName(
                parents.join(names.select("node"), "node", "left_anti")), total + rows)
        if n <= SMALL:
            break
        edges, n = _once(_renamed(_renamed(edges, parents, "a"), parents, "b"), n)
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = names.select(F.col("parent").alias("node")).distinct()
    return (names.select("node", F.col("parent").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
