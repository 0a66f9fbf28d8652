"""Connected components: of few edges in the driver's Python, of more by contraction to the smallest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by, settled

#: Edges, of 16 bytes, that are collected at most; more are contracted by joins. Edges that a task holds before it contracts them.
DRIVER_EDGES, TASK_EDGES = 1_000_000, 1_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest node that each of them reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(a):
        near = label[a], label[b]
        np.minimum.at(label, np.maximum(*near), np.minimum(*near))  # all are roots, so each root goes to its smallest neighbour
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def stars(pairs: DataFrame) -> DataFrame:
    """Edges a, b that connect what long columns a and b of ``pairs`` connect: in each task, a node and the smallest that
    it reaches there, so no more edges than nodes. Pairs don't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, TASK_EDGES

        def shrunk() -> tuple[np.ndarray, np.ndarray]:
            nodes, least = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return nodes[nodes != least], least[nodes != least]

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)))
            size += batch.num_rows
            if size > at:
                held = [shrunk()]
                size = len(held[0][0])
                at = 2 * size + TASK_EDGES
        if held:
            yield from pa.Table.from_pydict(dict(zip("ab", shrunk(), strict=True))).to_batches(max_chunksize=100_000)

    return pairs.select("a", "b").filter("a != b").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable), settled, of every node on an edge with two ends, from long columns
    a and b. Edges with a null end and loops are ignored. Up to ``DRIVER_EDGES`` edges are collected, which takes three
    jobs where contraction takes ten and more a round."""
    spark = edges.sparkSession
    left = settled(edges.filter("a != b").select("a", "b"))
    if left.count() > DRIVER_EDGES:
        return settled(_contracted_by_joins(left))
    met = left.toArrow()
    nodes, least = contracted(*(met.column(c).to_numpy().astype(np.int64) for c in "ab"))
    key = "spark.sql.execution.arrow.localRelationThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")  # as bytes, and not as rows in the driver's heap
    try:
        return settled(spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())})))
    finally:
        spark.conf.set(key, before)


def _contracted_by_joins(edges: DataFrame) -> DataFrame:
    """node, component of ``connected``.

    Each round maps every node to the first of its neighbours and itself in a fixed random order (a 64-bit hash, which is
    one to one on longs) and contracts the edges, until none is left; in random order chains shrink by a constant share a
    round and hubs at once. Minima are aggregated before they move, nodes with very many edges and components with very
    many nodes are joined where they are, and every round ends in reliable checkpoints.
    """

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    left = settled(edges.filter("a != b").select(*ordered("a", "b")).distinct())
    rounds = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        nearest = both.groupBy("node").agg(F.min_by("near", F.xxhash64("near")).alias("near"))
        parents = settled(nearest.select("node", F.when(F.xxhash64("near") < F.xxhash64("node"), F.col("near")).otherwise(F.col("node")).alias("parent")))
        rounds.append(parents)
        ends = [parents.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}")) for c in "ab"]
        met = joined_by(settled(joined_by(left, ends[0], "a", "inner")), ends[1], "b", "inner").filter("_a != _b")
        left = settled(met.select(*ordered("_a", "_b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0].withColumnRenamed("parent", "head")
    for parents in rounds[1:]:
        moved = parents.select(F.col("node").alias("head"), "parent")
        labels = settled(joined_by(labels, moved, "head").select("node", F.coalesce("parent", "head").alias("head")))
    least = labels.groupBy("head").agg(F.min("node").alias("component"))
    return joined_by(labels, least, "head", "inner").select("node", "component")
