"""Connected components of an edge table by joins alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Edges up to which one task merges them (16 bytes each); more are merged by joins over all tasks.
ONE_TASK = 300_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    ends = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in parts], axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(ends.shape)
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b longs); component is the smallest node reachable.

    Each round takes the smallest label among neighbours, then that of the label's
    own node, so a path shortens by doubling. Sums are partial before each
    shuffle and joins may be split, so a node with many edges is no hot spot. A
    counted, small number of edges is merged in one task instead.
    """
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return settle(edges.select("a", "b").coalesce(1).mapInArrow(_merged, "node long, component long"), "cc-labels")
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = settle(both, "cc-edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "old")
        step = settle(step, "cc-labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels
