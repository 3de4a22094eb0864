"""Connected components of links held in a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import remove, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the smallest node of its component among the given links."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def connected_components(links: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """``node, component, least`` for every node of ``links`` (``a``, ``b``): the reachable node of the least value, and that value.

    ``values`` has one row ``node, value`` for each node; without it a node is its own value. A label is a value with
    its node. Each round every node takes the least label among its neighbours and hands it to the node its own label
    names, then takes the label of that label's node; labels only fall, and rounds end when none does. Since whole
    trees of labels are joined, rounds grow with the logarithm of a component's size, not with its length. Labels
    are kept as tables in the checkpoint folder between rounds. Joins meet one row on the side of the labels, and
    what nodes are handed is pre-aggregated, so a node with very many links is split by adaptive execution.
    """
    spark = links.sparkSession
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, _ = stored(ends.distinct())
    label = lambda value, node: F.struct(F.col(value).alias("value"), F.col(node).alias("of"))
    nodes = edges.select(F.col("a").alias("node")).distinct()
    begun = nodes.withColumn("value", F.col("node")) if values is None else nodes.join(values, "node")
    labels, path = stored(begun.select("node", label("value", "node").alias("label"), F.lit(True).alias("changed")))
    while not labels.where("changed").isEmpty():
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        told = labels.join(heard, labels["node"] == heard["a"]).select(F.col("label.of").alias("a"), "near")
        offers = heard.unionByName(told).groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(offers, labels["node"] == offers["a"], "left").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        over = lower.select(F.col("node").alias("up"), F.col("low").alias("over"))
        jumped = lower.join(over, lower["low"]["of"] == over["up"]).select("node", F.least("low", "over").alias("label"), "was")
        before = path
        labels, path = stored(jumped.select("node", "label", (F.col("label") != F.col("was")).alias("changed")))
        remove(spark, before)
    return labels.select("node", F.col("label.of").alias("component"), F.col("label.value").alias("least"))
