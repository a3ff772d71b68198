"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label each node that has an edge with the smallest node it can reach: (node, component).

    Every round takes the smallest label among a node's neighbours and then follows the
    label's own label (pointer jumping), so chains shrink by half or better. Each round is
    written to the shared folder; only the number of changed labels reaches the driver.
    Edges with a null end are ignored; self-loops and repeated edges do no harm; no edges
    give an empty table.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(pairs.union(pairs.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        seen = labels.select(F.col("node").alias("b"), "label")
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("hop"))
        onward = labels.select(F.col("node").alias("hop"), F.col("label").alias("onward"))
        labels = materialize(hop.join(onward, "hop").select("node", "was", F.least("hop", "onward").alias("label")))
        if not labels.where("label < was").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")


def lowest(labels: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least label that each node, labelled with a node, reaches by edges, of graphs that one task holds."""
    while True:
        was = labels.copy()
        np.minimum.at(labels, labels[one], was[two])
        np.minimum.at(labels, labels[two], was[one])
        while (labels != labels[labels]).any():
            labels = labels[labels]
        if (labels == was).all():
            return labels
