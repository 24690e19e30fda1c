"""Confirming candidate pairs and joining links to groups, without collecting either."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Edges that one task joins: bounds its memory (about 100 bytes an edge).
FEW = 500_000


def confirm_by_sets(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the pairs whose sets (``rid, items``) have intersection >= threshold *
    union, in whole hundredths."""
    t = round(threshold * 100)
    left = sets.select(F.col("rid").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("rid").alias("b"), F.col("items").alias("_y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("_i", F.size(F.array_intersect("_x", "_y")))
    return stored(met.where(f"100L * _i >= {t}L * (size(_x) + size(_y) - _i)").select("a", "b"), "edges")


def _joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and of each the smallest node it reaches."""
    nodes, of = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, label = of[: len(x)], of[len(x) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (low == label[x]).all() and (low == label[y]).all():
            return nodes, nodes[label]
        for end in (x, y):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label = label[label]


def _few(edges: DataFrame) -> DataFrame:
    """``rid, label`` of a graph small enough for one task."""

    def run(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            nodes, labels = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["rid", "label"])

    kind = dict(edges.dtypes)["a"]
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"rid {kind}, label {kind}")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``rid, label``: of each node that has an edge, the smallest node it reaches.

    Graph contraction: every node takes its smallest neighbour or itself, takes that
    node's choice in turn, and the edges between choices form the next, smaller graph,
    until ``few`` edges at most are left, which one task joins. Each round is stored in
    the shared folder."""
    left, labels, n = edges.select("a", "b"), None, edges.count()
    while n > few:
        left = stored(left.where("a <> b").distinct(), "cc-edges")
        if labels is None:
            labels = left.select(F.explode(F.array("a", "b")).alias("rid")).distinct().withColumn("label", F.col("rid"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "cc-up")
        for _ in range(2):
            up = up.join(up.select(F.col("a").alias("up"), F.col("up").alias("top")), "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        up = stored(up, "cc-top")
        labels = stored(_through(labels, up, "a", "up"), "cc-labels")
        moved = left.join(up, "a").select(F.col("up").alias("x"), "b").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        left = stored(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
        n = left.count()
    last = stored(_few(left), "cc-last")
    return last if labels is None else stored(_through(labels, last, "rid", "label"), "cc-labels")


def _through(labels: DataFrame, by: DataFrame, node: str, top: str) -> DataFrame:
    """Labels replaced by what ``by`` has for them."""
    by = by.select(F.col(node).alias("label"), F.col(top).alias("_top"))
    return labels.join(by, "label", "left").select("rid", F.coalesce("_top", "label").alias("label"))
